"""Sums of per-term vectors over the terms of each text, without a shuffle of the texts.

Language scores, sentiment margins and embeddings are all sums, over the terms of a text,
of one vector per known term. The texts stay where they are: the JVM turns each into an
array of term hashes, and Arrow batches of those meet a broadcast table of vectors. Of a table
beyond the broadcast limit the commonest terms are met so, the others in parts of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.hashlists import counted, entries_of, part_of, runs
from reviewmill.session import cut_lineage, free_memory

# The driver and every Python worker hold a few times as much.
BROADCAST_BYTES = 32 * 1024 * 1024
# Of a larger table: bytes of a part, and how many parts there are at least on as many cores.
PART_TABLE_BYTES = 64 << 20
LEAST_PARTS = 8
WIDE = 16
_CHUNK = 1 << 16
_TOKENS = 1 << 18
_SENT = "part long, kind int, block long, terms binary, sizes binary, docs binary, values binary, weights binary, sums binary"
_ANSWERED = "block long, ids binary, docs binary, sums binary"


@dataclass
class TermTable:
    """Vectors of terms, as a table ``hash long, weight double, rows array<int>, values
    array<float>, vector array<float>``.

    ``weight`` scales a term (its idf). The vector of a term is either given in ``vector``
    or, far smaller for rare terms, as a combination ``values`` of the ``rows`` of ``basis``.
    """

    terms: DataFrame
    basis: np.ndarray
    term_count: int
    entries: int = 0
    dense_count: int = 0

    @property
    def width(self) -> int:
        return self.basis.shape[1]

    def slices(self, limit: int = BROADCAST_BYTES) -> int:
        """How many parts the table needs so that each stays within ``limit`` bytes."""
        size = self.term_count * 24 + self.entries * 8 + self.dense_count * self.width * 4
        room = max(limit - self.basis.nbytes, limit // 4)
        return max(1, -(-size // room))

    def most_common(self, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
        """The terms of least weight (the most frequent ones, where weights are idf) that fit into
        ``limit`` bytes together, and all others. Terms of one weight stay together. Beside a large
        basis only terms with a vector of their own are taken, which need none of it."""
        size = F.lit(24) + F.greatest(F.coalesce(F.size("rows"), F.lit(0)), F.lit(0)) * 8
        size = size + F.when(F.col("vector").isNotNull(), self.width * 4).otherwise(0)
        alone = self.basis.nbytes > limit // 4
        own = F.col("vector").isNotNull() if alone else F.lit(True)
        room, edge = limit - (0 if alone else self.basis.nbytes), None
        for row in self.terms.where(own).groupBy("weight").agg(F.sum(size).alias("size")).orderBy("weight").toLocalIterator():
            room -= row["size"]
            if room < 0:
                break
            edge = row["weight"]
        near = F.lit(False) if edge is None else own & (F.col("weight") <= F.lit(edge))
        return self.terms.where(near), self.terms.where(~near)

    def load(self, part: DataFrame) -> dict[str, np.ndarray]:
        """Terms of a bounded size, ready to broadcast."""
        table = part.select("hash", "weight", "rows", "values", "vector").toArrow().combine_chunks()
        order = np.argsort(table["hash"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()

        def lists(name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
            column = pa.chunked_array(table[name]).combine_chunks()
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return lengths.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(dtype)

        sizes, rows = lists("rows", np.int32)
        _, values = lists("values", np.float32)
        dense_sizes, dense = lists("vector", np.float32)
        basis = self.basis.astype(np.float32) if len(rows) else np.zeros((0, self.width), np.float32)
        if len(dense):
            # A term with its own vector points at one extra basis row.
            where = np.flatnonzero(dense_sizes)
            extra = len(basis) + np.arange(len(where), dtype=np.int32)
            starts = np.cumsum(sizes) - sizes
            rows = np.insert(rows, starts[where], extra)
            values = np.insert(values, starts[where], np.float32(1))
            sizes = sizes + (dense_sizes > 0)
            basis = np.vstack([basis, dense.reshape(-1, self.width)])
        return {
            "hashes": table["hash"].to_numpy(),
            "weights": table["weight"].to_numpy().astype(np.float64),
            "starts": np.concatenate([[0], np.cumsum(sizes)]),
            "rows": rows,
            "values": values,
            "basis": basis,
        }


def _segment_sums(doc: np.ndarray, rows: np.ndarray, scale: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Sum ``scale * basis[rows]`` per document; ``doc`` is ascending."""
    out = np.zeros((n, basis.shape[1]))
    for lo in range(0, len(doc), _CHUNK):
        part = doc[lo : lo + _CHUNK]
        picked = basis[rows[lo : lo + _CHUNK]] * scale[lo : lo + _CHUNK, None]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[first]] += np.add.reduceat(picked, first, axis=0)
    return out


def sum_batch(hashes: pa.Array, table: dict[str, np.ndarray], damped: bool) -> np.ndarray:
    """One row of sums per list of term hashes; the last column is the sum of the squared
    term weights."""
    n = len(hashes)
    lengths = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = hashes.flatten().to_numpy(zero_copy_only=False)
    known = table["hashes"]
    if not len(flat) or not len(known):
        return np.zeros((n, table["basis"].shape[1] + 1))
    doc = np.repeat(np.arange(n), lengths)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[at] == flat
    doc, at = doc[hit], at[hit]
    scale = table["weights"][at]
    if damped:
        key, times = np.unique(doc * len(known) + at, return_counts=True)
        doc, at = key // len(known), key % len(known)
        scale = (1 + np.log(times)) * table["weights"][at]
    squares = np.bincount(doc, weights=scale * scale, minlength=n)
    counts = np.diff(table["starts"])[at]
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    entry = np.repeat(table["starts"][at], counts) + place
    scale = np.repeat(scale, counts) * table["values"][entry]
    sums = _segment_sums(np.repeat(doc, counts), table["rows"][entry], scale, table["basis"], n)
    return np.column_stack([sums, squares])


def _scaled(sums: np.ndarray, unit: str | None) -> np.ndarray:
    """Drop the squares column after scaling by the length of the term weights or the sum."""
    values, squares = sums[:, :-1], sums[:, -1]
    if unit == "sum":
        squares = np.einsum("ij,ij->i", values, values)
    if unit:
        length = np.sqrt(squares)
        values = values / np.where(length > 0, length, 1)[:, None]
    return values


def to_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list array with one list per row."""
    matrix = np.ascontiguousarray(matrix)
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def with_term_sums(
    df: DataFrame,
    hashes: str | Callable[[DataFrame], DataFrame],
    table: TermTable,
    out: str,
    damped: bool,
    unit: str | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``out``: ``array<double>``, the sum of the term vectors of each row.

    ``hashes`` is a column, or adds the column ``_hashes``, which is not kept. With ``damped`` a
    term occurring t times counts ``1 + ln t`` times, else t times.
    ``unit`` scales by the length of the term weights (``terms``) or of the result (``sum``).

    A table beyond ``limit`` bytes does not pass through the driver: only its commonest terms are
    broadcast, and the others lie in parts (see ``_far_sums``). The rows are written once, without
    their terms, and their sums come back by row number.
    """
    context = df.sparkSession.sparkContext
    listed = hashes if callable(hashes) else lambda rows: rows.withColumn("_hashes", F.col(hashes))
    if table.slices(limit) == 1:
        shared = context.broadcast(table.load(table.terms))
        free_memory()
        return listed(df).withColumn(out, _sum_udf(shared, damped, unit)(F.col("_hashes"))).drop("_hashes")
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "term-rows")
    sums = _far_sums(listed(rows).select("_row", "_hashes"), table, out, damped, unit, limit)
    return rows.join(sums, "_row", "left").drop("_row")


def _far_sums(asked: DataFrame, table: TermTable, out: str, damped: bool, unit: str | None, limit: int) -> DataFrame:
    """``_row, out`` of rows ``_row, _hashes``, with a table of any size.

    The table is dealt into parts by ranges of hashes. Blocks of rows send each part the terms that
    it may have, each term once with its rows, and a part answers with one sum per row. What the
    commonest terms add is known in the block already. All of it travels in binary, no term is a row.
    """
    context, width = asked.sparkSession.sparkContext, table.width
    near, far = table.most_common(limit)
    shared, basis = context.broadcast(table.load(near)), context.broadcast(table.basis.astype(np.float32, copy=False))
    free_memory()
    parts = max(min(context.defaultParallelism, LEAST_PARTS), table.slices(PART_TABLE_BYTES))
    # sums of wide vectors travel as floats, as the vectors themselves are
    kind = np.float64 if width <= WIDE else np.float32
    sent = asked.mapInArrow(_asked_udf(shared, damped, parts, kind), _SENT)
    # empty instead of null: Spark's Arrow writer passes a batch's null lists again for every row
    lists = [F.coalesce(c, F.array().cast(f"array<{kind_of}>")).alias(c) for c, kind_of in (("rows", "int"), ("values", "float"), ("vector", "float"))]
    sent = sent.unionByName(far.select("hash", "weight", *lists).mapInArrow(_part_udf(width, parts), _SENT))
    met = sent.repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(_answers_udf(basis, width, damped, kind), _ANSWERED)

    def finished(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own = np.flatnonzero(group["ids"].is_valid().to_numpy(zero_copy_only=False))
        ids = np.frombuffer(group["ids"][int(own[0])].as_buffer(), np.int64)
        total = np.zeros((len(ids), width + 1))
        for given, sums in sorted(zip(group["docs"].to_pylist(), group["sums"].to_pylist())):
            at = np.frombuffer(given, np.int32)
            total[at] += np.frombuffer(sums, kind).reshape(len(at), width + 1)
        return pa.table([pa.array(ids), to_lists(_scaled(total, unit))], ["_row", out])

    return met.groupBy("block").applyInArrow(finished, f"_row bigint, {out} array<double>")


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``_SENT``; what a kind of rows does not have is null."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6)
    columns = [pa.array([None if x is None else x.tobytes() if isinstance(x, np.ndarray) else int(x) for x in c], k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["part", "kind", "block", "terms", "sizes", "docs", "values", "weights", "sums"])


def _coded(weights: np.ndarray) -> np.ndarray:
    """The distinct weights, of which there are few, after the number of each: codes compress."""
    distinct, code = np.unique(weights, return_inverse=True)
    return np.concatenate([code.astype(np.int32).view(np.uint8), distinct.astype(np.float64).view(np.uint8)])


def _decoded(given: pa.Buffer, n: int) -> np.ndarray:
    code = np.frombuffer(given, np.int32, n)
    return np.frombuffer(given[4 * n :].to_pybytes(), np.float64)[code]


def _cut(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The parts of ascending part numbers, each with its first and last place."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    for a, b in zip(first, np.r_[first[1:], len(part)]):
        yield int(part[a]), a, b


def _asked_udf(shared, damped: bool, parts: int, kind):
    """Blocks of rows, as the sums of their known terms, sent to any part, and their other terms."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unsigned(shared.value)
        for batch in batches:
            for piece in _pieces(batch.column(1)):
                ids = batch.column(0).slice(piece.offset - batch.column(1).offset, len(piece)).to_numpy()
                lengths = piece.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = piece.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                terms, sizes, doc, tf = counted(np.repeat(np.arange(len(ids)), lengths), flat)
                at, known = _found(terms, table)
                total = np.zeros((len(ids), table["basis"].shape[1] + 1))
                _add_sums(total, table, at[known], sizes[known], *(x[np.repeat(known, sizes)] for x in (doc, tf)), damped)
                everyone = np.arange(len(ids), dtype=np.int32)
                block, number = int(ids[0]), np.uint16 if len(ids) <= 1 << 16 else np.int32
                rows = [(block % parts, 1, block, ids.astype(np.int64), None, everyone, None, None, total.astype(kind))]
                rest = np.repeat(~known, sizes)
                terms, sizes, doc, tf = terms[~known], sizes[~known], doc[rest], tf[rest]
                ends = np.r_[0, np.cumsum(sizes)]
                for p, a, b in _cut(part_of(terms, parts)):
                    own = slice(ends[a], ends[b])
                    rows.append((p, 2, block, terms[a:b], sizes[a:b].astype(np.int32), doc[own].astype(number), tf[own].astype(np.int32), None, None))
                yield _sent(rows)

    return ask


def _part_udf(width: int, parts: int):
    """Terms with their vectors, by part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(0).to_numpy().view(np.uint64)
            if not len(terms):
                continue
            order = np.argsort(terms, kind="stable")
            batch, terms = batch.take(pa.array(order)), terms[order]
            weights = batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy().astype(np.int32)
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            own = batch.column(4).value_lengths().to_numpy() > 0
            vectors = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            ends, dense = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(own)]
            sizes[own] = -1
            found = []
            for p, a, b in _cut(part_of(terms, parts)):
                listed = slice(ends[a], ends[b])
                found.append((p, 0, 0, terms[a:b], sizes[a:b], rows[listed], values[listed], _coded(weights[a:b]), vectors[dense[a] : dense[b]]))
            yield _sent(found)

    return deal


def _answers_udf(basis, width: int, damped: bool, kind):
    """Of rows by part, its terms first: what the part adds to each row of a block."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, table = None, [], None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["part"].as_py() != part:
                    part, held, table = row["part"].as_py(), [], None
                which = row["kind"].as_py()
                if which == 0:
                    kinds = (("terms", np.uint64), ("sizes", np.int32), ("docs", np.int32), ("values", np.float32), ("sums", np.float32))
                    lists = [np.frombuffer(row[c].as_buffer(), d).copy() for c, d in kinds]
                    held.append([*lists[:4], _decoded(row["weights"].as_buffer(), len(lists[0])), lists[4]])
                elif which == 1:
                    out.append((row["block"].as_py(), row["terms"].as_py(), row["docs"].as_py(), row["sums"].as_py()))
                else:
                    if table is None:
                        table, held = _table_of(held, basis.value, width), []
                    terms, sizes, tf = (np.frombuffer(row[c].as_buffer(), d) for c, d in (("terms", np.uint64), ("sizes", np.int32), ("values", np.int32)))
                    given = row["docs"].as_buffer()
                    doc = np.frombuffer(given, np.int32 if given.size == tf.nbytes else np.uint16).astype(np.int32)
                    at, known = _found(terms, table)
                    if known.any():
                        kept = np.repeat(known, sizes)
                        docs, doc = np.unique(doc[kept], return_inverse=True)
                        total = np.zeros((len(docs), width + 1))
                        _add_sums(total, table, at[known], sizes[known].astype(np.int64), doc, tf[kept], damped)
                        out.append((row["block"].as_py(), None, docs.tobytes(), total.astype(kind).tobytes()))
            if out:
                kinds = (pa.int64(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "ids", "docs", "sums"])

    return answer


def _table_of(held: list[list[np.ndarray]], basis: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The terms of a part like those that ``TermTable.load`` gives, but by unsigned hash."""
    empty = [np.zeros(0, d) for d in (np.uint64, np.int32, np.int32, np.float32, np.float64, np.float32)]
    terms, sizes, rows, values, weights, vectors = (np.concatenate(c) for c in zip(*(held or [empty])))
    own, listed = sizes < 0, np.maximum(sizes, 0).astype(np.int64)
    starts = np.cumsum(listed) - listed
    starts[own] = np.arange(np.count_nonzero(own))  # of ``vectors``
    order = np.argsort(terms, kind="stable")
    return {
        "hashes": terms[order], "weights": weights[order], "starts": starts[order], "sizes": sizes[order],
        "rows": rows, "values": values, "basis": basis, "vectors": vectors.reshape(-1, width),
    }


def _unsigned(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A table that ``TermTable.load`` gave, by unsigned hash."""
    hashes = table["hashes"].view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    sizes = np.diff(table["starts"]).astype(np.int32)
    nothing = np.zeros((0, table["basis"].shape[1]), np.float32)
    return {**table, "hashes": hashes[order], "weights": table["weights"][order], "starts": table["starts"][:-1][order], "sizes": sizes[order], "vectors": nothing}


def _found(terms: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each term in a table, and whether it is there."""
    hashes = table["hashes"]
    if not len(hashes):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    at = np.minimum(np.searchsorted(hashes, terms), len(hashes) - 1)
    return at, hashes[at] == terms


def _vectors_of(table: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The vectors of terms of a table."""
    sizes, starts = table["sizes"][at], table["starts"][at]
    out = np.zeros((len(at), table["basis"].shape[1]))
    own, listed = sizes < 0, sizes > 0
    if own.any():
        out[own] = table["vectors"][starts[own]]
    if listed.any():
        number = sizes[listed].astype(np.int64)
        entry = entries_of(starts[listed], number)
        picked = table["basis"][table["rows"][entry]] * table["values"][entry, None].astype(np.float64)
        out[listed] = np.add.reduceat(picked, np.cumsum(number) - number, axis=0)
    return out


def _add_sums(total: np.ndarray, table: dict[str, np.ndarray], at: np.ndarray, sizes: np.ndarray, doc: np.ndarray, tf: np.ndarray, damped: bool) -> None:
    """Add to the rows of ``total`` the vectors of the terms ``at``, each of which ``sizes`` of ``doc``
    hold ``tf`` times, and the squares of the term weights."""
    ends = np.r_[0, np.cumsum(sizes)]
    for lo, hi in runs(sizes, _CHUNK):
        vectors, weight = _vectors_of(table, at[lo:hi]), np.repeat(table["weights"][at[lo:hi]], sizes[lo:hi])
        rows, times = doc[ends[lo] : ends[hi]], tf[ends[lo] : ends[hi]]
        scale = (1 + np.log(times) if damped else times) * weight
        total[:, -1] += np.bincount(rows, scale * scale if damped else times * weight * weight, len(total))
        term = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        order = np.argsort(rows, kind="stable")
        rows, term, scale = rows[order], term[order], scale[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total[rows[first], :-1] += np.add.reduceat(vectors[term] * scale[:, None], first, axis=0)


def _pieces(hashes: pa.Array) -> Iterator[pa.Array]:
    """The lists in runs of about ``_TOKENS`` entries, so that a batch of long texts takes no more."""
    ends = np.cumsum(hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(hashes):
        taken = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, taken + _TOKENS, side="right")))
        yield hashes.slice(lo, hi - lo)
        lo = hi


def _sum_udf(shared, damped: bool, unit: str | None):
    def add(hashes: pa.Array) -> pa.Array:
        if not len(hashes):
            return pa.array([], pa.list_(pa.float64()))
        return to_lists(np.vstack([_scaled(sum_batch(piece, shared.value, damped), unit) for piece in _pieces(hashes)]))

    return F.arrow_udf(add, "array<double>")


def softmax_columns(margins: Column, count: int) -> list[Column]:
    """Class probabilities from an array column of ``count`` margins."""
    top = F.array_max(margins)
    parts = [F.exp(margins[i] - top) for i in range(count)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return [part / total for part in parts]
