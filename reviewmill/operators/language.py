"""Language detection learned from rows that declare their language.

A naive Bayes model over letter groups. Training is one aggregate over all labelled texts;
scoring is a sum per text against the (small) profile table, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.terms import letter_groups, term_hashes
from reviewmill.operators.termsum import BROADCAST_BYTES, TermTable, with_term_sums
from reviewmill.schemas import MIN_MEANINGFUL_LENGTH, UNKNOWN_LANGUAGE


def language_profiles(labelled: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """How often each letter group occurs in each language: ``language, letters, n``."""
    return (
        labelled.where(F.col(language).isNotNull() & (F.col(language) != UNKNOWN_LANGUAGE))
        .select(F.col(language).alias("language"), F.explode(letter_groups(text)).alias("letters"))
        .groupBy("language", "letters")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass
class LanguageModel:
    languages: list[str]
    penalties: list[float]
    table: TermTable


def fit_language_model(profiles: DataFrame) -> LanguageModel:
    """Naive Bayes with add-one smoothing and equal priors.

    ``score = sum ln(n + 1) - groups * ln(N + V)`` is the usual log likelihood with the
    part common to known and unknown groups taken out of the sum.
    """
    totals = profiles.groupBy("language").agg(F.sum("n").alias("total")).orderBy("language")
    rows = totals.collect()  # one row per language
    if not rows:
        raise ValueError("cannot learn languages from no labelled text")
    languages = [row.language for row in rows]
    position = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    terms = profiles.groupBy(F.xxhash64("letters").alias("hash")).agg(
        F.lit(1.0).alias("weight"),
        F.collect_list(F.element_at(position, F.col("language"))).alias("rows"),
        F.collect_list(F.log(F.col("n") + 1.0).cast("float")).alias("values"),
        F.lit(None).cast("array<float>").alias("vector"),
    )
    sizes = profiles.agg(F.count_distinct("letters").alias("v"), F.count(F.lit(1)).alias("e")).first()
    table = TermTable(terms, np.eye(len(languages)), term_count=sizes.v, entries=sizes.e)
    return LanguageModel(languages, [float(np.log(row.total + sizes.v)) for row in rows], table)


def detect_language(
    df: DataFrame, model: LanguageModel, text: str, out: str = "language", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Add the most likely language, or ``und`` for texts under three characters, texts
    without letters, and NULL texts (which cost nothing)."""
    step = df.withColumn("_groups", term_hashes(letter_groups(F.when(F.length(F.trim(text)) >= MIN_MEANINGFUL_LENGTH, F.col(text)))))
    step = with_term_sums(step, "_groups", model.table, "_sums", damped=False, limit=limit)
    scored = F.array(
        *[
            F.struct(
                (F.col("_sums")[i] - F.size("_groups") * F.lit(penalty)).alias("score"),
                F.lit(name).alias("language"),
            )
            for i, (name, penalty) in enumerate(zip(model.languages, model.penalties, strict=True))
        ]
    )
    best = F.array_max(scored)["language"]
    return step.withColumn(
        out, F.when(F.size("_groups") > 0, best).otherwise(F.lit(UNKNOWN_LANGUAGE))
    ).drop("_groups", "_sums")


def resolve_language(
    df: DataFrame, model: LanguageModel | None, text: str, declared: str = "language", out: str = "language"
) -> DataFrame:
    """The declared language, else the detected one; declared rows are not scored."""
    if model is None:
        return df.withColumn(out, F.coalesce(F.col(declared), F.lit(UNKNOWN_LANGUAGE)))
    step = df.withColumn("_undeclared", F.when(F.col(declared).isNull(), F.col(text)))
    step = detect_language(step, model, "_undeclared", "_detected")
    return step.withColumn(out, F.coalesce(F.col(declared), F.col("_detected"))).drop("_undeclared", "_detected")
