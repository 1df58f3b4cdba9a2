"""Vectors as both searches take them: valid rows, equal vectors once, hits back to ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage


def valid_vectors(rows: DataFrame, key: str, vector: str, value: Column) -> DataFrame:
    """``id, h1, h2, v`` of the rows that take part.

    Left out are rows without an id, and vectors that are null, empty, or hold null or
    non-finite components. ``value`` turns the double array ``x`` into the array that is searched.
    The keys are 128 bits of the vector's hash.
    """
    inf = F.lit(float("inf"))
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: c + F.lit(0.0))  # -0.0 is 0.0
    plain = rows.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    plain = plain.where((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)))
    found = plain.select("id", value.alias("v"))
    return found.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")


def distinct_vectors(valid: DataFrame, keep: int) -> DataFrame:
    """``h1, h2, ids, v``: every distinct vector with its ``keep`` smallest ids. Ids beyond these
    cannot be among ``keep`` hits; they fall before the shuffle, whatever a vector's copies."""
    order = Window.partitionBy("h1", "h2").orderBy("id")
    first = valid.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= keep)
    return first.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, width)


def hits_of(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best per query, ties to the smaller id.

    ``entries`` are ``q1, q2, score, ids`` per query vector; ``queries`` are ``id, h1, h2``. A row
    with the query's own id is no hit; of several rows of one id the best counts.
    """
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
    best = entries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = best.groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    mine = queries.select("id", "h1", "h2").distinct()
    joined = mine.join(lists, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    each = joined.select(F.col("id").alias("query_id"), F.explode("hits").alias("h")).select("query_id", "h.score", F.explode("h.ids").alias("vec_id"))
    each = each.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def by_width(distinct: DataFrame, mine: DataFrame, search: Callable[[DataFrame, DataFrame, int], DataFrame], schema: str) -> DataFrame:
    """``search(vectors, queries, width)`` for the vectors of each width that a query (``id, h1, h2, w``) has,
    one width after the other: only vectors of one width have a score."""
    widths = [r["w"] for r in mine.select("w").distinct().orderBy("w").collect()]
    found = [search(distinct.where(F.size("v") == w), mine.where(F.col("w") == w).drop("w"), w) for w in widths]
    return reduce(DataFrame.unionByName, found) if found else distinct.sparkSession.createDataFrame([], schema)


def sample_matrix(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The ``n`` vectors that come first by hash: a fixed, bounded sample for laying out cells."""
    return matrix(rows.orderBy("h1", "h2").limit(n).select("v").toArrow().column("v"), width)


def meet(index: DataFrame, visits: DataFrame, search, schema: str, per_task: int) -> DataFrame:  # noqa: ANN001
    """``search(rows, queries)`` for every block and the queries that visit it.

    ``index`` and ``visits`` have ``cell, block``. Where more than ``per_task`` queries visit a
    block, they are dealt to several tasks and the block goes to each.
    """
    visits = cut_lineage(visits, "visits")
    counts = visits.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.select("cell", "block", F.ceil(F.col("_n") / per_task).cast("int").alias("_shares"))
    left = index.join(shares, ["cell", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    right = visits.join(shares, ["cell", "block"]).withColumn("share", F.pmod(F.xxhash64("h2", "h1"), F.col("_shares")).cast("int")).drop("_shares")
    left = left.select(F.col("cell").alias("lc"), F.col("block").alias("lb"), F.col("share").alias("ls"), *[F.col(c).alias(c) for c in index.columns if c not in ("cell", "block")])
    right = right.select(F.col("cell").alias("rc"), F.col("block").alias("rb"), F.col("share").alias("rs"), *[F.col(c).alias(c) for c in visits.columns if c not in ("cell", "block")])
    return left.groupBy("lc", "lb", "ls").cogroup(right.groupBy("rc", "rb", "rs")).applyInArrow(search, schema)
