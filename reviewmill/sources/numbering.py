"""Row numbers per input file without moving a file into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.joins import settled

_BLOCK_KEY = ["path", "_block"]


def file_columns() -> list[Column]:
    """Where a row came from: file, offset of its split in the file, order inside the task."""
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    ]


def with_row_numbers(rows: DataFrame, first: int) -> DataFrame:
    """Add ``row_number``, counted per file from ``first``.

    A split is read in order by one task, so a row's number is the number of rows in the
    splits before it plus its place in its own split. Only one small row per split is
    shuffled; the rows themselves stay where they were read.
    """
    splits = rows.groupBy(*_BLOCK_KEY).agg(
        F.min("_seq").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        *_BLOCK_KEY, "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    offsets, small = settled(offsets)
    if small:
        offsets = F.broadcast(offsets)
    return (
        rows.join(offsets, _BLOCK_KEY)
        .withColumn("row_number", F.col("_before") + F.col("_seq") - F.col("_start") + F.lit(first))
        .drop("_block", "_seq", "_start", "_before")
    )
