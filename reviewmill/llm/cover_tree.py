"""Exact top-k inner products by dual-tree search over cover trees.

Rows and queries are both indexed by cover trees: a node has a centre, which is one of its
points, and a covering radius; its children's centres are at least half of that radius apart and
cover it with half of the radius. For a query node with centre a and radius r, and a data node
with centre b and radius s, no pair of points has an inner product above
``a.b + |a| s + |b| r + r s``; the pair of nodes is pruned where this is below the worst k-th
score of the query node.

The topmost level is a net over a bounded sample; every row goes to its nearest centre and so
into that centre's blocks, every query into the group of its cell. A group first searches the
block it comes from, and then goes to the blocks that the bound leaves. Tasks build the trees of
one block and of the queries that visit it. Scores are whole numbers and exact.
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

BLOCK_ROWS = 2048
MOST_CELLS = 4096
SAMPLE = 20_000
LEAF = 32
QUERIES_PER_TASK = 2048
EXACT = float(1 << 52)
ENTRIES = "q1 long, q2 long, score long, ids array<long>"


class CoverTree:
    """A cover tree over the rows of a matrix: per node its centre row, covering radius, children
    and, at the bottom, rows."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norms = np.sqrt((points * points).sum(axis=1))
        squares = self.norms**2
        # blocks are small, so all distances are at hand
        gram = points @ points.T
        self.distances = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * gram, 0))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray | None] = []
        if len(points):
            self._build()

    def _node(self, centre: int, rows: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(self.distances[centre, rows].max()))
        self.children.append(None)
        self.rows.append(rows)
        return len(self.centre) - 1

    def _build(self) -> None:
        todo = [self._node(0, np.arange(len(self.points)))]
        while todo:
            node = todo.pop()
            rows, radius = self.rows[node], self.radius[node]
            if len(rows) <= LEAF or radius <= 1e-9 * (1 + self.norms[self.centre[node]]):
                continue
            rest, centre, made = rows, self.centre[node], []
            while len(rest):
                near = self.distances[centre, rest] <= radius / 2
                near |= rest == centre
                made.append(self._node(centre, rest[near]))
                rest = rest[~near]
                if len(rest):
                    centre = int(rest[0])
            self.children[node], self.rows[node] = np.array(made), None
            todo += made
        self.centres = np.array(self.centre)
        self.radii = np.array(self.radius)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes one level down; leaves stay."""
        return np.concatenate([self.children[i] if self.children[i] is not None else np.array([i]) for i in nodes])


class TopK:
    """The best ``k`` rows per query by score, ties to the smaller first id."""

    def __init__(self, data: np.ndarray, first_id: np.ndarray, queries: np.ndarray, k: int, worst: np.ndarray):
        self.data, self.first_id, self.queries, self.k = data, first_id, queries, k
        self.floor = worst.astype(float)
        self.rows = [np.empty(0, np.int64) for _ in queries]
        self.scores = [np.empty(0) for _ in queries]

    def offer(self, queries: np.ndarray, rows: np.ndarray) -> None:
        scores = self.queries[queries] @ self.data[rows].T
        for q, own in zip(queries, scores, strict=True):
            good = own >= self.floor[q]
            if not good.any():
                continue
            held = np.concatenate([self.rows[q], rows[good]])
            value = np.concatenate([self.scores[q], own[good]])
            best = np.lexsort((self.first_id[held], -value))[: self.k]
            self.rows[q], self.scores[q] = held[best], value[best]
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], value[best[-1]])


def dual_search(data: CoverTree, queries: CoverTree, top: TopK) -> None:
    """Walk both trees together, pruning pairs of nodes."""
    if not data.centre or not queries.centre:
        return
    todo = [(0, np.array([0]))]
    while todo:
        q, nodes = todo.pop()
        rows = queries.rows[q]
        if rows is None:
            rows = _rows_below(queries, q)
        c, r = queries.centre[q], queries.radius[q]

        def bounds(nodes: np.ndarray, c: int = c, r: float = r) -> np.ndarray:
            centres = data.centres[nodes]
            product = data.points[centres] @ queries.points[c]
            reach = queries.norms[c] * data.radii[nodes] + data.norms[centres] * r + r * data.radii[nodes]
            return product + reach + 1e-12 * (queries.norms[c] * data.norms[centres] + reach) + 1e-6

        value = bounds(nodes)
        nodes = nodes[value >= top.floor[rows].min()]
        if not len(nodes):
            continue
        if queries.children[q] is not None:
            below = data.below(nodes)
            todo += [(int(child), below) for child in queries.children[q]]
            continue
        while len(nodes):
            value = bounds(nodes)
            order = np.argsort(-value, kind="stable")
            nodes, value = nodes[order], value[order]
            nodes = nodes[value >= top.floor[rows].min()]
            ends = np.array([data.children[i] is None for i in nodes], bool)
            if ends.any():
                # the most promising leaves first, so that the others may fall to the bound
                first = nodes[ends][:16]
                top.offer(rows, np.concatenate([data.rows[i] for i in first]))
                nodes = nodes[~np.isin(nodes, first)]
            elif len(nodes):
                nodes = data.below(nodes)


def _rows_below(tree: CoverTree, node: int) -> np.ndarray:
    out, todo = [], [node]
    while todo:
        i = todo.pop()
        if tree.rows[i] is not None:
            out.append(tree.rows[i])
        else:
            todo += tree.children[i].tolist()
    return np.concatenate(out)


def net(points: np.ndarray, count: int) -> np.ndarray:
    """Centres of the topmost level: each the point farthest from those before it."""
    if not len(points):
        return points
    chosen, away = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * (points @ centres.T), axis=1)


def exact_scores(rows: list[list[int]], query: list[int]) -> list[int]:
    """Whole-number inner products of any size; beyond 64 bits they saturate."""
    top = (1 << 63) - 1
    return [max(-top - 1, min(top, sum(a * b for a, b in zip(row, query, strict=True)))) for row in rows]


def top_products(vectors: DataFrame, key: str, vector: str, value: Column, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest integer inner products per query.

    ``value`` makes whole numbers of the double array ``x``. Queries are rows where ``is_query``,
    candidates all others; ties go to the smaller id. Null, empty and non-finite vectors and rows
    without an id take no part; zero vectors do. Vectors of each width are searched by themselves.
    Equal vectors are searched once. Products are exact while the sum of their terms' sizes stays below 2^52, and computed digit by digit
    beyond, where bounds prune less. An empty table, or one without queries, has no result.
    """
    valid = valid_vectors(vectors, key, vector, value)
    queries = vectors.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    distinct = cut_lineage(distinct_vectors(valid, k + 1), "vectors")
    mine = cut_lineage(valid.join(queries, "id", "left_semi").select("id", "h1", "h2", F.size("v").alias("w")), "queries")
    return by_width(distinct, mine, lambda rows, asked, width: _top_of_width(rows, asked, width, k), "query_id long, rank int, vec_id long, score long")


def _top_of_width(distinct: DataFrame, mine: DataFrame, width: int, k: int) -> DataFrame:
    """The search among vectors of one width."""
    n = distinct.count()
    centres = net(sample_matrix(distinct, SAMPLE, width), max(1, min(MOST_CELLS, -(-n // BLOCK_ROWS))))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column("v"), width)
                cell = _nearest_centre(points, centres)
                away = np.sqrt(((points - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    index = cut_lineage(distinct.mapInArrow(placed, "h1 long, h2 long, ids array<long>, v array<long>, cell long, away double"), "index")
    covers = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).orderBy("cell").collect()  # MOST_CELLS at most
    names = np.array([c["cell"] for c in covers], np.int64)
    radii = np.array([c["r"] for c in covers]) if covers else np.empty(0)
    blocks = np.array([-(-c["n"] // BLOCK_ROWS) for c in covers], np.int64)
    block_table = distinct.sparkSession.createDataFrame([(int(c), int(b)) for c, b in zip(names, blocks, strict=True)] or [(-1, 1)], "cell long, blocks long")
    index = index.join(F.broadcast(block_table), "cell").withColumn("block", F.pmod("h1", "blocks")).drop("blocks", "away")
    lowest = -math.inf
    asked = index.join(mine.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("cell", "block", "h1", "h2", "v", F.lit(lowest).alias("floor"))

    def search(rows: pa.Table, qs: pa.Table) -> pa.Table:
        q1, q2, scores, out = [], [], [], []
        if rows.num_rows and qs.num_rows:
            data, asked_ = matrix(rows.column("v"), width), matrix(qs.column("v"), width)
            ids = rows.column("ids").to_pylist()
            first_id = np.array([i[0] for i in ids])
            floors = qs.column("floor").to_numpy()
            exact = float(np.abs(data).max(initial=0)) * float(np.abs(asked_).max(initial=0)) * width < EXACT
            keys = list(zip(qs.column("h1").to_pylist(), qs.column("h2").to_pylist(), strict=True))
            if exact:
                top = TopK(data, first_id, asked_, k + 1, floors)
                dual_search(CoverTree(data), CoverTree(asked_), top)
                found = [(held, value.astype(np.int64).tolist()) for held, value in zip(top.rows, top.scores, strict=True)]
            else:
                whole = rows.column("v").to_pylist()
                found = []
                for q in qs.column("v").to_pylist():
                    s = exact_scores(whole, q)
                    best = sorted(range(len(s)), key=lambda j: (-s[j], first_id[j]))[: k + 1]
                    found.append((np.array(best), [s[j] for j in best]))
            for (a, b), (held, value) in zip(keys, found, strict=True):
                for j, s in zip(held, value, strict=True):
                    q1.append(a)
                    q2.append(b)
                    scores.append(s)
                    out.append(ids[j])
        return pa.table({"q1": pa.array(q1, pa.int64()), "q2": pa.array(q2, pa.int64()), "score": pa.array(scores, pa.int64()), "ids": pa.array(out, pa.list_(pa.int64()))})

    home = cut_lineage(meet(index, asked, search, ENTRIES, QUERIES_PER_TASK), "home-hits")
    kth = home.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s"))
    floor = F.when(F.col("_n") > k, F.col("_s").cast("double")).otherwise(lowest)
    bounded = asked.drop("floor").join(kth, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").select("cell", "block", "h1", "h2", "v", floor.alias("floor"))
    centre_norms = np.sqrt((centres * centres).sum(axis=1)) if len(centres) else np.empty(0)

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # queries of one cell share most of their bounds, so whole groups stay or go together
        for batch in batches:
            if not batch.num_rows:
                continue
            points, floors = matrix(batch.column("v"), width), batch.column("floor").to_numpy()
            own_cell, own_block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            for cell in np.unique(own_cell):
                group = np.flatnonzero(own_cell == cell)
                centre = centres[cell]
                r = float(np.sqrt(((points[group] - centre) ** 2).sum(axis=1)).max())
                reach = centre_norms[cell] * radii + centre_norms[names] * r + r * radii
                slack = 1e-9 * (centre_norms[cell] * centre_norms[names] + reach) + 1e-6  # of either sign of the bound
                near = np.flatnonzero(centres[names] @ centre + reach + slack >= floors[group].min())
                norms = np.sqrt((points[group] ** 2).sum(axis=1))
                reach = norms[:, None] * radii[near][None, :]
                slack = 1e-9 * (norms[:, None] * centre_norms[names[near]] + reach) + 1e-6
                which, to = np.nonzero(points[group] @ centres[names[near]].T + reach + slack >= floors[group][:, None])
                copies = blocks[near[to]]
                which, to = np.repeat(group[which], copies), np.repeat(near[to], copies)
                block = np.arange(len(to)) - np.repeat(np.cumsum(copies) - copies, copies)
                other = (names[to] != own_cell[which]) | (block != own_block[which])
                if other.any():
                    rest = batch.select(["h1", "h2", "v", "floor"]).take(pa.array(which[other]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[to[other]]), pa.array(block[other]), *rest.columns], names=["cell", "block", "h1", "h2", "v", "floor"])

    going = bounded.mapInArrow(visits, "cell long, block long, h1 long, h2 long, v array<long>, floor double")
    rest = meet(index, going, search, ENTRIES, QUERIES_PER_TASK)
    return hits_of(home.unionByName(rest), mine, k)
