"""Approximate nearest reviews by an inverted file: vectors are stored by cell, a search reads few.

Cells are the neighbourhoods of centres found on a bounded sample; every vector is stored in the
folder of its cell. A query probes the cells whose centres are most similar to it, and the scan
skips all other folders. How many cells that takes is measured, not guessed: for a sample of
stored vectors the true neighbours are looked up once, and ``reach`` tells which share of them
lies in the first, the first two, ... cells of their query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.functions.vectors import as_matrix
from reviewmill.operators.search import PRODUCT_CELLS, best_per_query, in_scope, search_many, unit_rows
from reviewmill.schemas import SEARCH_LIMIT

MOST_CELLS = 4096
SAMPLE_ROWS = 20_000
ROUNDS = 10
CALIBRATION_QUERIES = 256
RECALL = 0.95
QUERY_BYTES = 32 << 20
# What a task keeps of each of a query's neighbours: hits not yet thinned out, and copies while they are sorted.
HIT_BYTES = 4 * 24 * 3
_STORED = "vectors"


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of every point, by products of PRODUCT_CELLS numbers at a time."""
    step = max(1, PRODUCT_CELLS // len(centres))
    parts = [np.argmax(points[low : low + step] @ centres.T, axis=1) for low in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 13) -> np.ndarray:
    """Directions of ``cells`` groups of the sample's vectors (spherical k-means)."""
    points = unit_rows(sample)
    points = points[points.any(axis=1)]
    if not len(points):
        return np.zeros((1, sample.shape[1]))
    centres = points[np.random.default_rng(seed).choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(rounds):
        own = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres[held] = unit_rows(sums[held])
    return centres


@dataclass
class CellIndex:
    """A written index: where it lies, its centres and the measured ``reach``."""

    path: str
    centres: np.ndarray
    reach: np.ndarray
    schema: str

    def vectors(self, spark: SparkSession) -> DataFrame:
        # an index of no vectors has no file to learn the columns from
        return spark.read.schema(self.schema).parquet(f"{self.path}/{_STORED}")

    def probes(self, recall: float) -> int:
        """The fewest cells that hold ``recall`` of the neighbours of the calibration."""
        return min(len(self.centres), int(np.searchsorted(self.reach, recall)) + 1)

    def probed(self, queries: np.ndarray, counts: np.ndarray, limit: int, recall: float) -> np.ndarray:
        """The cells that each query reads, as bits: those that hold ``recall`` of the neighbours, and
        further ones until they hold ``limit`` of the ``counts`` rows. Ranked a piece at a time."""
        step = max(1, PRODUCT_CELLS // len(self.centres))
        out = np.zeros((len(queries), -(-len(self.centres) // 8)), np.uint8)
        for low in range(0, len(queries), step):
            order = self.ranked(queries[low : low + step])
            enough = np.argmax(np.cumsum(counts[order], axis=1) >= min(limit, counts.sum()), axis=1) + 1
            depth = np.maximum(enough, self.probes(recall))
            part = np.zeros(order.shape, bool)
            np.put_along_axis(part, order, np.arange(order.shape[1]) < depth[:, None], axis=1)
            out[low : low + step] = np.packbits(part, axis=1, bitorder="little")
        return out

    def ranked(self, queries: np.ndarray) -> np.ndarray:
        """All cells of each query, the most similar centre first."""
        return np.argsort(-(unit_rows(queries) @ self.centres.T), axis=1, kind="stable")


def build_index(
    embeddings: DataFrame, path: str, cells: int | None = None, limit: int = SEARCH_LIMIT, sample_rows: int = SAMPLE_ROWS, seed: int = 13
) -> CellIndex:
    """Store ``embeddings`` (``review_id``, ``embedding`` and any other columns) by cell at ``path``.

    Centres and reach come from bounded samples, taken in the order of a hash of the id; every
    row with a vector is stored. Vectors must be of one width, another is an error. Without
    ``cells`` there are as many as the square root of the rows, times two, MOST_CELLS at most.
    """
    spark = embeddings.sparkSession
    given = embeddings.where(F.col("embedding").isNotNull())
    head = given.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if head["a"] != head["b"]:
        raise ValueError(f"vectors of {head['a']} to {head['b']} components in one index")
    order = F.xxhash64("review_id")
    width = head["b"] or 1
    sample, _ = as_matrix(given.orderBy(order, "review_id").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks(), width)
    centres = fit_centres(sample, cells or max(1, min(MOST_CELLS, round(2 * head["n"] ** 0.5))), seed=seed)

    def placed(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.int32())
        return pa.array(nearest_centre(unit_rows(as_matrix(vectors, width)[0]), centres).astype(np.int32))

    rows = given.withColumn("cell", F.arrow_udf(placed, "int")("embedding"))
    # rows of a cell go to one task, unless they are many: then the planner splits them
    rows.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/{_STORED}")
    index = CellIndex(path, centres, np.ones(len(centres)), _columns(rows))
    index.reach = _measured_reach(index, index.vectors(spark), limit) if head["n"] else index.reach
    spark.createDataFrame([(index.schema,)], "columns string").coalesce(1).write.parquet(f"{path}/columns")
    stored = [(i, [float(x) for x in c], float(r)) for i, (c, r) in enumerate(zip(centres, index.reach, strict=True))]
    spark.createDataFrame(stored, "cell int, centre array<double>, reach double").write.parquet(f"{path}/centres")
    return index


def load_index(spark: SparkSession, path: str) -> CellIndex:
    """The index written at ``path``."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
    columns = spark.read.parquet(f"{path}/columns").first()["columns"]
    return CellIndex(path, np.array([r["centre"] for r in rows]), np.array([r["reach"] for r in rows]), columns)


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _measured_reach(index: CellIndex, stored: DataFrame, limit: int) -> np.ndarray:
    """Per number of probed cells the share of true neighbours in them, for CALIBRATION_QUERIES
    stored vectors. A query is not counted as its own neighbour."""
    asked = stored.orderBy(F.xxhash64(F.lit(1), "review_id"), "review_id").limit(CALIBRATION_QUERIES)
    asked = asked.select(F.col("review_id").alias("query_id"), "embedding")
    found = search_many(stored, asked, limit + 1).where("review_id <> query_id")
    pairs = found.join(stored.select("review_id", "cell"), "review_id").select("query_id", "cell").toArrow()  # a bounded sample's hits
    queries = asked.toArrow()
    if not pairs.num_rows:
        return np.ones(len(index.centres))
    place = np.argsort(index.ranked(as_matrix(queries["embedding"].combine_chunks(), index.centres.shape[1])[0]), axis=1)
    row = {q: i for i, q in enumerate(queries["query_id"].to_pylist())}
    ranks = place[[row[q] for q in pairs["query_id"].to_pylist()], pairs["cell"].to_numpy()]
    return np.cumsum(np.bincount(ranks, minlength=len(index.centres))) / len(ranks)


def ann_search_many(
    spark: SparkSession, index: CellIndex, queries: DataFrame, limit: int = SEARCH_LIMIT, recall: float = RECALL, query_bytes: int = QUERY_BYTES, **scope: object
) -> DataFrame:
    """``query_id, review_id, similarity, rank`` of the nearest vectors found, best first, ties by id.

    Similarities are exact. Every query (``query_id``, ``embedding``) probes as many cells as reached
    ``recall`` at the calibration, and further ones until these hold ``limit`` rows of the scope,
    so that ``min(limit, n)`` rows come. Queries go out in blocks of ``query_bytes``, with their probed cells
    and the hits that a task keeps counted in; for each only the
    folders that one of its queries probes are read. Queries without a vector have no result.
    """
    vectors = in_scope(index.vectors(spark), **scope)
    counts = np.zeros(len(index.centres), np.int64)
    for r in vectors.groupBy("cell").count().collect():  # a row per cell
        counts[r["cell"]] = r["count"]
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    width = index.centres.shape[1]
    held = 8 * width + -(-len(index.centres) // 8) + HIT_BYTES * limit
    blocks = max(1, -(-asked.count() * held // query_bytes))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((asked, "query_id"), (vectors, "review_id"))]
    schema = f"{', '.join(kinds)}, similarity double"
    found: DataFrame | None = None
    for i in range(blocks):
        rows = asked.where(block == i).toArrow()
        if not rows.num_rows:
            continue
        matrix = unit_rows(as_matrix(rows["embedding"].combine_chunks(), width)[0])
        probed = index.probed(matrix, counts, limit, recall)
        any_query = np.unpackbits(np.bitwise_or.reduce(probed, axis=0), count=len(counts), bitorder="little")
        read = np.flatnonzero((any_query > 0) & (counts > 0)).tolist()
        near = vectors.where(F.col("cell").isin(read)).select("review_id", "embedding", "cell")
        part = near.mapInArrow(best_per_query(rows["query_id"].combine_chunks(), matrix, limit, probed), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    ranking = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "review_id")
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= limit)


def ann_search(spark: SparkSession, index: CellIndex, query: list[float], limit: int = SEARCH_LIMIT, recall: float = RECALL, **scope: object) -> DataFrame:
    """``review_id, similarity`` of the nearest vectors found for one query, best first."""
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<double>")
    found = ann_search_many(spark, index, asked, limit, recall, **scope)
    return found.orderBy("rank").select("review_id", "similarity")
