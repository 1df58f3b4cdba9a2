"""Approximate nearest neighbours by stable projections.

Unit vectors are projected to DIMENSIONS Gaussian directions. The squared projected distance of
two points over their squared distance then follows a chi-square law, whatever their width. A
kd-tree over the projections yields neighbours in order of projected distance; each is verified
by its true distance. The search ends when a point beyond the current projected radius would be
nearer than the worst neighbour held, divided by APPROXIMATION, only with probability
1 - CONFIDENCE.

The tree's upper levels are cells, laid out on a bounded sample; every row is indexed. A query
first searches the block of its own cell, and then goes only to the cells whose box lies within
its radius. Each block has a tree of its own. No number of candidates is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.vectorsets import by_width, distinct_vectors, hits_of, matrix, meet, sample_matrix, valid_vectors
from reviewmill.session import cut_lineage

DIMENSIONS = 12
CONFIDENCE = 0.97
APPROXIMATION = 1.05
CELL_ROWS = 4096
MOST_CELLS = 4096
SAMPLE = 20_000
LEAF = 64
LEAVES_AT_ONCE = 16
VERIFIED_AT_ONCE = 256
QUERIES_PER_TASK = 16_384
ENTRIES = "q1 long, q2 long, score double, ids array<long>"


def chi_square(x: float, freedom: int = DIMENSIONS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(freedom // 2))


def radius_factor(confidence: float = CONFIDENCE, approximation: float = 1.0) -> float:
    """Projected radius over the worst distance held at which the search stops: a point
    ``approximation`` times nearer lies beyond it with probability 1 - ``confidence``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < confidence else (low, mid)
    return math.sqrt(high) / approximation


def directions(width: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, DIMENSIONS))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # tiny and huge vectors keep their direction
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Cells:
    """The upper levels of the kd-tree: median cuts of the widest dimension of a sample."""

    def __init__(self, points: np.ndarray, count: int):
        self.cuts: list[tuple[int, float]] = []
        self.levels = max(0, math.ceil(math.log2(max(1, count))))
        groups = [np.arange(len(points))]
        for _ in range(self.levels):
            halves = []
            for g in groups:
                held = points[g]
                axis = int(np.argmax(np.ptp(held, axis=0))) if len(g) else 0
                at = float(np.median(held[:, axis])) if len(g) else 0.0
                self.cuts.append((axis, at))
                halves += [g[held[:, axis] < at], g[held[:, axis] >= at]] if len(g) else [g, g]
            groups = halves

    def of(self, points: np.ndarray) -> np.ndarray:
        cell, base = np.zeros(len(points), np.int64), 0
        for level in range(self.levels):
            axis = np.array([a for a, _ in self.cuts[base : base + (1 << level)]])
            at = np.array([v for _, v in self.cuts[base : base + (1 << level)]])
            right = points[np.arange(len(points)), axis[cell]] >= at[cell]
            base += 1 << level
            cell = 2 * cell + right
        return cell


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The rows of a kd-tree's leaves."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        g = todo.pop()
        if len(g) <= LEAF:
            out.append(g)
            continue
        axis = int(np.argmax(np.ptp(points[g], axis=0)))
        order = g[np.argsort(points[g, axis], kind="stable")]
        todo += [order[: len(g) // 2], order[len(g) // 2 :]]
    return out


def search_block(
    v: np.ndarray, p: np.ndarray, first_id: np.ndarray, qv: np.ndarray, qp: np.ndarray, bounds: np.ndarray, k: int, factor: float
) -> tuple[list[np.ndarray], int]:
    """Rows of the ``k`` nearest found per query, ties to the smaller first id, and how many rows
    were verified. ``bounds`` are true distances beyond which a query needs no point."""
    u, qu = unit(v), unit(qv)
    rows = leaves(p)
    low = np.array([p[g].min(axis=0) for g in rows])
    high = np.array([p[g].max(axis=0) for g in rows])
    out, verified = [], 0
    for q in range(len(qv)):
        gap = np.maximum(np.maximum(low - qp[q], qp[q] - high), 0)
        lower = np.sqrt((gap * gap).sum(axis=1))
        order = np.argsort(lower, kind="stable")
        held, dist, worst, at = np.empty(0, np.int64), np.empty(0), float(bounds[q]), 0
        while at < len(order) and lower[order[at]] <= factor * worst + 1e-9:
            more = np.concatenate([rows[j] for j in order[at : at + LEAVES_AT_ONCE]])
            at += LEAVES_AT_ONCE
            away = np.sqrt(((p[more] - qp[q]) ** 2).sum(axis=1))
            nearest_first = np.argsort(away, kind="stable")
            more, away = more[nearest_first], away[nearest_first]
            for start in range(0, len(more), VERIFIED_AT_ONCE):  # the radius shrinks as neighbours are found
                some = more[start : start + VERIFIED_AT_ONCE][away[start : start + VERIFIED_AT_ONCE] <= factor * worst + 1e-9]
                if not len(some):
                    break
                verified += len(some)
                d = np.sqrt(np.maximum(2 - 2 * (u[some] @ qu[q]), 0))
                near = d <= worst + 1e-9
                held, dist = np.concatenate([held, some[near]]), np.concatenate([dist, d[near]])
                if len(held) > k:
                    best = np.lexsort((first_id[held], dist))[: 4 * k]  # more than k, as rounding may swap near ties
                    held, dist = held[best], dist[best]
                if len(held) >= k:
                    worst = min(worst, float(dist[k - 1]) if len(dist) > k else float(dist.max()))
        out.append(held)
    return out, verified


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines on the original vectors, each row summed alike wherever it stands. Powers of two
    are taken out first, which changes no digit and keeps squares of any double finite."""
    rows, query = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]) for x in (rows, query))
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` (cosine, largest first) of the ``k`` nearest found.

    Queries are rows where ``is_query``; candidates all others. Null, zero, empty and non-finite
    vectors take no part, nor do rows without an id; vectors of each width are searched by
    themselves; equal vectors are searched once; ties go to the smaller id. An empty table, or one without queries, has no result.
    """
    valid = valid_vectors(vectors, key, vector, F.col("x")).where(F.exists("v", lambda c: c != 0))
    queries = vectors.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    distinct = cut_lineage(distinct_vectors(valid, k + 1), "vectors")
    mine = cut_lineage(valid.join(queries, "id", "left_semi").select("id", "h1", "h2", F.size("v").alias("w")), "queries")
    return by_width(distinct, mine, lambda rows, asked, width: _nearest_of_width(rows, asked, width, k), "query_id long, rank int, vec_id long, score double")


def _nearest_of_width(distinct: DataFrame, mine: DataFrame, width: int, k: int) -> DataFrame:
    """The search among vectors of one width."""
    n = distinct.count()
    normal, factor = directions(width), radius_factor(CONFIDENCE, APPROXIMATION)
    count = min(MOST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, n / CELL_ROWS)))))
    sample = sample_matrix(distinct, SAMPLE, width)
    cells = Cells(unit(sample) @ normal if len(sample) else np.empty((0, DIMENSIONS)), count)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = unit(matrix(batch.column("v"), width)) @ normal
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(p)), flat], names=[*batch.schema.names, "cell", "p"])

    index = cut_lineage(distinct.mapInArrow(placed, "h1 long, h2 long, ids array<long>, v array<double>, cell long, p array<double>"), "index")
    boxes = index.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *[f(F.col("p")[i]).alias(f"{s}{i}") for s, f in (("a", F.min), ("b", F.max)) for i in range(DIMENSIONS)]
    ).orderBy("cell").collect()  # MOST_CELLS rows at most
    names = np.array([r["cell"] for r in boxes], np.int64)
    low = np.array([[r[f"a{i}"] for i in range(DIMENSIONS)] for r in boxes]).reshape(-1, DIMENSIONS)
    high = np.array([[r[f"b{i}"] for i in range(DIMENSIONS)] for r in boxes]).reshape(-1, DIMENSIONS)
    blocks = np.array([-(-r["n"] // CELL_ROWS) for r in boxes], np.int64)
    block_table = distinct.sparkSession.createDataFrame([(int(c), int(b)) for c, b in zip(names, blocks, strict=True)] or [(-1, 1)], "cell long, blocks long")
    index = index.join(F.broadcast(block_table), "cell").withColumn("block", F.pmod("h1", "blocks")).drop("blocks")
    asked = index.join(mine.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("cell", "block", "h1", "h2", "v", "p", F.lit(math.inf).alias("bound"))

    def search(rows: pa.Table, qs: pa.Table) -> pa.Table:
        if not rows.num_rows or not qs.num_rows:
            return pa.table({"q1": pa.array([], pa.int64()), "q2": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        v, ids = matrix(rows.column("v"), width), rows.column("ids").to_pylist()
        qv = matrix(qs.column("v"), width)
        first_id = np.array([i[0] for i in ids])
        found, _ = search_block(v, matrix(rows.column("p"), DIMENSIONS), first_id, qv, matrix(qs.column("p"), DIMENSIONS), qs.column("bound").to_numpy(), k + 1, factor)
        q1, q2, scores, out = [], [], [], []
        for a, b, q, held in zip(qs.column("h1").to_pylist(), qs.column("h2").to_pylist(), qv, found, strict=True):
            s = cosine(v[held], q)
            for j in np.lexsort((first_id[held], -s))[: k + 1]:
                q1.append(a)
                q2.append(b)
                scores.append(float(s[j]))
                out.append(ids[held[j]])
        return pa.table({"q1": pa.array(q1, pa.int64()), "q2": pa.array(q2, pa.int64()), "score": pa.array(scores, pa.float64()), "ids": pa.array(out, pa.list_(pa.int64()))})

    home = cut_lineage(meet(index, asked, search, ENTRIES, QUERIES_PER_TASK), "home-hits")
    kth = home.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s"))
    far = F.when(F.col("_n") > k, F.sqrt(F.greatest(2 - 2 * F.col("_s"), F.lit(0.0))) + 1e-9).otherwise(math.inf)
    bounded = asked.drop("bound").join(kth, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").select("cell", "block", "h1", "h2", "v", "p", far.alias("bound"))

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                p = matrix(part.column("p"), DIMENSIONS)
                gap = np.maximum(np.maximum(low - p[:, None], p[:, None] - high), 0)
                radius = factor * part.column("bound").to_numpy() + 1e-9
                which, to = np.nonzero(np.sqrt((gap * gap).sum(axis=2)) <= radius[:, None])
                copies = blocks[to]
                which, to = np.repeat(which, copies), np.repeat(to, copies)
                block = np.arange(len(to)) - np.repeat(np.cumsum(copies) - copies, copies)
                other = (names[to] != part.column("cell").to_numpy()[which]) | (block != part.column("block").to_numpy()[which])
                rest = part.select(["h1", "h2", "v", "p", "bound"]).take(pa.array(which[other]))
                yield pa.RecordBatch.from_arrays([pa.array(names[to[other]]), pa.array(block[other]), *rest.columns], names=["cell", "block", *rest.schema.names])

    going = bounded.mapInArrow(visits, "cell long, block long, h1 long, h2 long, v array<double>, p array<double>, bound double")
    rest = meet(index, going, search, ENTRIES, QUERIES_PER_TASK)
    return hits_of(home.unionByName(rest), mine, k)
