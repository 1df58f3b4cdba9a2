"""Joins that hold when one key owns a large share of the rows.

Two ways, chosen by a checked size: a lookup side is written once, and broadcast when its
files are small; a larger one is shuffled, with every hot key of the big side split over
several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage

ROWS_PER_TASK = 2_000_000
BROADCAST_FILE_BYTES = 8 << 20
_NULL_KEY_SPLITS = 4096


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files below a table that was just written, as the planner lists them."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def settled(df: DataFrame, max_bytes: int = BROADCAST_FILE_BYTES) -> tuple[DataFrame, bool]:
    """``df`` computed and written once, and whether its files are small enough to broadcast.

    The limit is on compressed Parquet, well below what the keys take in memory.
    """
    table = cut_lineage(df, "lookup")
    return table, stored_bytes(table) <= max_bytes


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK, count: str | None = None
) -> DataFrame:
    """Keys with more rows than one task should take, and the number of tasks to give them.

    At most ``rows / rows_per_task`` keys can qualify, so the result is broadcast-safe.
    Pass ``count`` when ``df`` is already one row per key with its row count.
    """
    counts = df if count else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    rows = F.col(count or "_rows")
    return counts.where(rows > rows_per_task).select(
        *keys, F.ceil(rows / F.lit(rows_per_task)).cast("int").alias("_splits")
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    hot: DataFrame,
    spread: Sequence[str],
) -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) with the hot keys of ``left`` split.

    Rows of a hot key go to different tasks by a hash of ``spread``; the single matching
    row of ``right`` is repeated once per split. Rows with a NULL key cannot match and are
    spread as well, so they never pile up in one task.
    """
    keys = list(keys)
    has_null: Column = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread_hash = F.xxhash64(*spread)
    big = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_split",
            F.when(has_null, F.pmod(spread_hash, F.lit(_NULL_KEY_SPLITS)))
            .when(F.col("_splits").isNotNull(), F.pmod(spread_hash, F.col("_splits")))
            .otherwise(F.lit(0))
            .cast("int"),
        )
        .drop("_splits")
    )
    small = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_split", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
        .drop("_splits")
    )
    return big.join(small, [*keys, "_split"], how).drop("_split")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Sequence[str],
    hot: DataFrame | None = None,
    max_bytes: int = BROADCAST_FILE_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
    small: bool | None = None,
) -> DataFrame:
    """Join to a lookup side: broadcast when its files are small, else split.

    Pass ``small`` when ``right`` has been ``settled`` before.
    """
    if small is None:
        right, small = settled(right, max_bytes)
    if small:
        return left.join(F.broadcast(right), list(keys), how)
    if hot is None:
        hot = hot_keys(left.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), keys, rows_per_task)
    return split_join(left, right, keys, how, hot, spread)
