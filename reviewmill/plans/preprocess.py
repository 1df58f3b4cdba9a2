"""Raw review text to clean, masked, folded, hashed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions import text as X
from reviewmill.operators.language import LanguageModel, resolve_language


def preprocess_reviews(df: DataFrame, model: LanguageModel | None = None, text: str = "text") -> DataFrame:
    """Add ``text_redacted``, ``text_normalized``, ``content_hash``, ``is_meaningful`` and the
    resolved ``language`` (the input's ``language`` column is the declared one, if any).

    A chain of projections: no shuffle, and each text is read once.
    """
    if "language" not in df.columns:
        df = df.withColumn("language", F.lit(None).cast("string"))
    cleaned = (
        df.withColumn("text_redacted", X.mask_pii(X.normalize_text(text)))
        .withColumn("text_normalized", X.casefold("text_redacted"))
        .withColumn("content_hash", X.content_hash("text_normalized"))
        .withColumn("is_meaningful", X.is_meaningful("text_redacted"))
    )
    return resolve_language(cleaned, model, "text_redacted")
