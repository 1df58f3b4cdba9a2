"""The import job: files in, deduplicated reviews, per-row outcomes and a summary out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions.ids import uuid7
from reviewmill.operators.dedup import FILE_ORDER, ordered_dual_key_dedup
from reviewmill.operators.joins import settled
from reviewmill.operators.keyindex import StoredKeys
from reviewmill.operators.language import LanguageModel
from reviewmill.operators.validation import validate_rows
from reviewmill.plans.preprocess import preprocess_reviews
from reviewmill.session import cut_lineage
from reviewmill.sources.reviews import Paths, files_not_utf8, read_reviews

# Fixed value: the reason given for text that is empty or nearly so after cleaning.
TOO_SHORT = "text too short after cleaning"

IMPORTED, DUPLICATE, REJECTED = "imported", "duplicate", "rejected"


def classify_import(
    validated: DataFrame,
    stored: DataFrame | StoredKeys | None = None,
    model: LanguageModel | None = None,
    order: tuple[str, ...] = FILE_ORDER,
) -> DataFrame:
    """Every row with ``outcome`` (imported, duplicate, rejected) and ``reason``.

    ``validated`` carries organization_id, product_id, source_id and the row order. The
    cleaned rows are written once, and so are the keys of the accepted ones; whatever derives
    from the result reads these, so rows are not written again. Accepted keys are broadcast
    when their files are small.
    """
    prepared = preprocess_reviews(validated, model)
    prepared = prepared.withColumn(
        "reason", F.coalesce("error", F.when(~F.col("is_meaningful"), F.lit(TOO_SHORT)))
    )
    prepared = cut_lineage(prepared, "import-rows")
    keys = ["organization_id", "content_hash", "source_id", "external_id"]
    candidates = prepared.where(F.col("reason").isNull()).select(*keys, *order)
    accepted = ordered_dual_key_dedup(candidates, stored, order=order)
    accepted, small = settled(accepted.withColumn("_accepted", F.lit(True)))
    flagged = prepared.join(F.broadcast(accepted) if small else accepted, list(order), "left")
    return flagged.withColumn(
        "outcome",
        F.when(F.col("reason").isNotNull(), REJECTED).when(F.col("_accepted"), IMPORTED).otherwise(DUPLICATE),
    ).drop("_accepted", "error", "is_meaningful")


def import_summary(classified: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """total_rows, imported, duplicates, rejected per file (or other columns)."""
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("outcome") == IMPORTED).alias("imported"),
        F.count_if(F.col("outcome") == DUPLICATE).alias("duplicates"),
        F.count_if(F.col("outcome") == REJECTED).alias("rejected"),
    )


def import_errors(classified: DataFrame, order: tuple[str, ...] = FILE_ORDER) -> DataFrame:
    """Rejected rows with their reason; sort by the row order to read them in sequence."""
    return classified.where(F.col("outcome") == REJECTED).select(*order, "reason")


def accepted_reviews(classified: DataFrame, ingested_at: Column, order: tuple[str, ...] = FILE_ORDER) -> DataFrame:
    """The imported rows as rows of the reviews table.

    Ids are derived from the row's place and content, so writing again writes the same ids.
    """
    seed = [F.col(c) for c in ("organization_id", "source_id", *order, "content_hash")]
    return classified.where(F.col("outcome") == IMPORTED).select(
        uuid7(F.unix_millis(ingested_at), *seed).alias("id"),
        "organization_id",
        "product_id",
        "source_id",
        "external_id",
        "rating",
        "language",
        "text_redacted",
        "text_normalized",
        "content_hash",
        "occurred_at",
        ingested_at.alias("ingested_at"),
        F.lit("pending").alias("status"),
        F.col("attributes").alias("metadata"),
        ingested_at.alias("created_at"),
    )


@dataclass
class ImportResult:
    """Outcome of an import: the classified rows and what derives from them."""

    classified: DataFrame
    reviews: DataFrame
    summary: DataFrame
    errors: DataFrame
    failed_files: DataFrame


def import_reviews(
    spark: SparkSession,
    paths: Paths,
    source_format: str,
    *,
    organization_id: Column,
    product_id: Column,
    source_id: Column,
    ingested_at: Column,
    stored: DataFrame | StoredKeys | None = None,
    model: LanguageModel | None = None,
) -> ImportResult:
    """Read, validate, clean, deduplicate and classify review files in one job.

    The owner columns may be literals or expressions over ``path``. A file with bytes that
    are not UTF-8 fails as a whole and imports nothing. Nothing is stored here; append
    ``result.reviews`` with ``sources.tables.append_reviews``.
    """
    failed, few = settled(files_not_utf8(spark, paths))
    raw = read_reviews(spark, paths, source_format).join(F.broadcast(failed) if few else failed, "path", "left_anti")
    owned = validate_rows(raw).withColumns(
        {"organization_id": organization_id, "product_id": product_id, "source_id": source_id}
    )
    classified = classify_import(owned, stored, model)
    return ImportResult(
        classified=classified,
        reviews=accepted_reviews(classified, ingested_at),
        summary=import_summary(classified),
        errors=import_errors(classified),
        failed_files=failed,
    )
