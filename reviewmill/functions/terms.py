"""Words, word pairs and letter groups of a text as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.text import WORD

# A token is a run of two or more word characters.
TOKEN_PATTERN = rf"[{WORD}]{{2,}}"


def tokens(c: Column | str) -> Column:
    """Lower-cased word tokens of at least two characters."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def with_terms(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the array of single tokens and adjacent token pairs, repeats included."""
    words = F.col("_words")
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return (
        df.withColumn("_words", F.coalesce(tokens(text), F.array().cast("array<string>")))
        .withColumn(out, F.concat(words, pairs))
        .drop("_words")
    )


def term_hashes(terms: Column) -> Column:
    """64-bit hashes of an array of terms: what the models look terms up by."""
    return F.transform(terms, lambda t: F.xxhash64(t))


def with_hashes(text: str) -> Callable[[DataFrame], DataFrame]:
    """What adds the hashes of a text's terms as ``_hashes``."""
    return lambda df: with_terms(df, text, "_terms").withColumn("_hashes", term_hashes(F.col("_terms"))).drop("_terms")


def letter_groups(c: Column | str) -> Column:
    """All overlapping groups of three in the lower-cased letters of a text, words set apart
    by single spaces."""
    col = F.col(c) if isinstance(c, str) else c
    letters = F.lower(F.regexp_replace(F.concat(F.lit(" "), col, F.lit(" ")), r"[^\p{L}]+", " "))
    return F.regexp_extract_all(letters, F.lit(r"(?=(...))"), F.lit(1))
