"""Products with the document-by-term weight matrix, as passes over term postings.

A posting row is one term with the documents it occurs in. With one (short) vector per
document broadcast, a single pass gives the vector of every term, and going back to the
documents in the same task gives ``A A'`` times the vectors. Both need the document side to
be small, which callers check.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.termsum import to_lists
from reviewmill.session import cut_lineage

_BLOCK = 1024
_CHUNK = 1 << 15
# Of ``A A'``: rows of a block, documents from which a term is dense, dense terms at a time, and the
# most tasks, as each holds a whole matrix.
_GRAM_BLOCK = 128
_DENSE = 64
_DENSE_ROWS = 256
GRAM_TASKS = 12


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lists with about ``_CHUNK`` entries in total."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        taken = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, taken + _CHUNK, side="right")))
        yield lo, hi
        lo = hi


def _term_sums(rows: pa.Array, values: pa.Array, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of terms: (documents, values, term number, summed vector per term)."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    doc, value = rows.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64)
    for lo, hi in _chunks(sizes):
        d, v = doc[at[lo] : at[hi]], value[at[lo] : at[hi]]
        sums = np.add.reduceat(v[:, None] * vectors[d], at[lo:hi] - at[lo], axis=0)
        yield d, v, np.repeat(np.arange(hi - lo), sizes[lo:hi]), sums


def _product_udf(shared):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total = np.zeros_like(q)
        for batch in batches:
            for d, v, term, sums in _term_sums(batch.column(0), batch.column(1), q):
                order = np.argsort(d, kind="stable")
                d, added = d[order], (v[:, None] * sums[term])[order]
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                total[d[first]] += np.add.reduceat(added, first, axis=0)
        for block in range(0, len(q), _BLOCK):
            part = total[block : block + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "part"]
                )

    return partial


def _gram_udf(n: int):
    """Like ``_product_udf`` for all of ``A A'``: a term adds the outer product of its few values, and
    terms of many documents go as dense blocks of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        flat = total.reshape(-1)
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            doc, value = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(np.float64)
            dense = np.flatnonzero(sizes > _DENSE)
            for lo in range(0, len(dense), _DENSE_ROWS):
                some = dense[lo : lo + _DENSE_ROWS]
                at = _entries(starts[some], sizes[some])
                block = np.zeros((len(some), n))
                block[np.repeat(np.arange(len(some)), sizes[some]), doc[at]] = value[at]
                for row in range(0, n, _GRAM_BLOCK):
                    total[row : row + _GRAM_BLOCK] += block[:, row : row + _GRAM_BLOCK].T @ block
            few = np.flatnonzero(sizes <= _DENSE)
            for lo, hi in _chunks(sizes[few] ** 2):
                some = few[lo:hi]
                at = _entries(starts[some], sizes[some])
                each = np.repeat(sizes[some], sizes[some])
                left, right = np.repeat(at, each), _entries(np.repeat(starts[some], sizes[some]), each)
                np.add.at(flat, doc[left].astype(np.int64) * n + doc[right], value[left] * value[right])
        for block in range(0, n, _GRAM_BLOCK):
            part = total[block : block + _GRAM_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    return partial


def _entries(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of several lists, one list after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _add_up(table: pa.Table) -> pa.Table:
    total = np.frombuffer(table["part"][0].as_buffer()).copy()
    for part in table["part"][1:]:
        total += np.frombuffer(part.as_buffer())
    return pa.table({"block": [table["block"][0].as_py()], "part": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Postings:
    """``table``: term, df, idf, rows array<int>, values array<float>; rows are document
    places 0..n-1."""

    table: DataFrame
    places: DataFrame
    n: int

    def own_squares(self) -> np.ndarray:
        """What the terms of a single document add to that document's own entry of ``A A'``.
        Most word pairs are such terms, and they need no product."""
        first = F.col("values")[0].cast("double")
        single = self.table.where(F.col("df") == 1).groupBy(F.col("rows")[0].alias("place"))
        own = np.zeros(self.n)
        for row in single.agg(F.sum(first * first).alias("s")).collect():
            own[row.place] = row.s
        return own

    def product(self, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``A A'`` times one vector per document."""
        shared = self.table.sparkSession.sparkContext.broadcast(vectors)
        out = own[:, None] * vectors
        self._add_blocks(out, _product_udf(shared))
        shared.unpersist()
        return out

    def gram(self) -> np.ndarray:
        """All of ``A A'``, in as many steps as pairs of documents share terms."""
        out = np.diag(self.own_squares())
        self._add_blocks(out, _gram_udf(self.n), GRAM_TASKS)
        return out

    def _add_blocks(self, out: np.ndarray, partial, tasks: int | None = None) -> None:
        """Add to ``out`` the blocks of rows that the tasks make of the common terms; they arrive
        one partition after the other."""
        common = self.table.where(F.col("df") > 1).select("rows", "values")
        common = common.coalesce(tasks) if tasks else common
        schema = "block long, part binary"
        summed = common.mapInArrow(partial, schema).groupBy("block").applyInArrow(_add_up, schema)
        for row in summed.toLocalIterator():
            part = np.frombuffer(row.part).reshape(-1, out.shape[1])
            out[row.block : row.block + len(part)] += part

    def with_vectors(self, vectors: np.ndarray, out: str = "vector") -> DataFrame:
        """Add the vector of each term: the weighted sum over its documents."""
        shared = self.table.sparkSession.sparkContext.broadcast(vectors)

        def add(rows: pa.Array, values: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.list_(pa.float32()))
            sums = [s for *_, s in _term_sums(rows, values, shared.value)]
            return to_lists(np.vstack(sums).astype(np.float32))

        return self.table.withColumn(out, F.arrow_udf(add, "array<float>")("rows", "values"))


def build_postings(docs: DataFrame, weights: DataFrame, idf: DataFrame, n: int) -> Postings:
    """Group the weights of a corpus of ``n`` documents (a checked, small number) by term."""
    places = docs.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("place"))
    grouped = (
        weights.join(F.broadcast(places), "id")
        .groupBy("term")
        .agg(F.collect_list("place").alias("rows"), F.collect_list(F.col("weight").cast("float")).alias("values"))
    )
    return Postings(cut_lineage(grouped.join(idf.select("term", "df", "idf"), "term"), "postings"), places, n)
