"""Label counts and shares. Three labels per group: partial counts do nearly all the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("organization_id", "product_id", "model_version")


def sentiment_distribution(
    sentiments: DataFrame,
    organization_id: object | None = None,
    product_id: object | None = None,
    model_version: object | None = None,
) -> DataFrame:
    """Count per label of each tenant, product and version; labels that do not occur have no
    row. Arguments restrict the scope (and prune partitions)."""
    for column, value in zip(SCOPE, (organization_id, product_id, model_version), strict=True):
        if value is not None:
            sentiments = sentiments.where(F.col(column) == F.lit(value))
    return sentiments.groupBy(*SCOPE, "label").agg(F.count(F.lit(1)).alias("count"))


def sentiment_percentages(distribution: DataFrame) -> DataFrame:
    """Add ``total`` and ``percentage`` (one decimal, ties to even); empty stays empty."""
    scope = Window.partitionBy(*SCOPE)
    return distribution.withColumn("total", F.sum("count").over(scope)).withColumn(
        "percentage", F.bround(F.col("count") / F.col("total") * 100, 1)
    )


def label_counts(scored: DataFrame) -> DataFrame:
    """Labels of one scoring run."""
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
