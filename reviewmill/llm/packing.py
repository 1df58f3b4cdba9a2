"""Packing documents into sequences as a cutting-stock problem, solved by column generation.

Documents are cut at full sequences, and what remains once more at a multiple of GRAIN tokens,
so that there are few lengths and none is rounded: pieces of whole grains, and tails shorter
than a grain. Their lengths are counted into a histogram. A linear program finds how often each
pattern (so many pieces of each length that fit one sequence) is used; new patterns come from a
knapsack over the program's prices. Rounded down, patterns are handed to pieces by their rank in
their length; the few pieces left over are laid first-fit, longest first. Tails have a program
of their own.

Only the histogram (a row per length that occurs) reaches the driver. Ids never shuffle: a
piece is a row of numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.encoding import encoder
from reviewmill.llm.words import batches_of, bound_batches, freeing
from reviewmill.session import cut_lineage

GRAIN = 64
SLACK = 2e-3
ROUNDS = 1000
RANK_ROWS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """The pieces of every whole text: full sequences, whole grains, and a tail.

    ``docs`` has ``doc_id`` and ``text``, other columns are ignored. A null or empty text is
    the end id alone; repeated rows are documents of their own; a null ``doc_id`` stays null.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grain = encoder(tokenizer), math.gcd(GRAIN, capacity)
        for batch, texts in batches_of(batches, "text"):
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = known.with_end(text, end).astype("<u4")
                starts = [*range(0, len(ids), capacity), len(ids)]
                tail = len(ids) - (len(ids) - starts[-2]) % grain
                if starts[-2] < tail < len(ids):
                    starts.insert(-1, tail)
                for start, stop in zip(starts, starts[1:]):
                    piece = ids[start:stop]
                    rows.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(freeing(cut), PIECES)


def knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest price that fits ``capacity``, any number of each class.

    Repeating a class along its residues is a running maximum, so each class costs a few
    array operations over the capacity.
    """
    best = np.zeros(capacity + 1)
    tables, used = [], [j for j in range(len(sizes)) if prices[j] > 1e-12]
    for j in used:
        size, price = sizes[j], prices[j]
        rows = -(-(capacity + 1) // size)
        grid = np.full(rows * size, -np.inf)
        grid[: capacity + 1] = best
        grid = grid.reshape(rows, size) - price * np.arange(rows)[:, None]
        tables.append(best)
        best = (np.maximum.accumulate(grid, axis=0) + price * np.arange(rows)[:, None]).ravel()[: capacity + 1]
    pattern, at = np.zeros(len(sizes), np.int64), capacity
    for j, before in zip(reversed(used), reversed(tables), strict=True):
        size, price = sizes[j], prices[j]
        counts = np.arange(at // size + 1)
        k = int(np.argmax(before[at - counts * size] + counts * price))
        pattern[j], at = k, at - k * size
    return float(pattern @ prices), pattern


def column_generation(sizes: list[int], demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, at an optimum of the linear program up to
    SLACK. The basis is as wide as there are classes; its inverse is updated in place."""
    m = len(sizes)
    single = np.array([capacity // s for s in sizes], float)
    columns, inverse, amounts = np.diag(single), np.diag(1 / single), demand / single
    for _ in range(ROUNDS):
        value, pattern = knapsack(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + SLACK:
            break
        change = inverse @ pattern
        ratios = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        amounts = np.maximum(amounts - step * change, 0)
        amounts[out] = step
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[:, out] = pattern
    return columns.astype(np.int64), amounts


def plan_patterns(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times used, pieces per class) of patterns that take every piece: the program's, rounded
    down, then first-fit with the longest first for the pieces left over (at most a sequence
    for every class)."""
    if not sizes:
        return []
    left = np.array(demand, np.int64)
    columns, amounts = column_generation(sizes, left.astype(float), capacity)
    plan: list[tuple[int, dict[int, int]]] = []
    for k in np.argsort(-amounts):
        column = columns[:, k]
        held = column > 0
        times = min(int(amounts[k] + 1e-6), int((left[held] // column[held]).min())) if held.any() else 0
        if times > 0:
            left -= times * column
            plan.append((times, {int(j): int(column[j]) for j in np.flatnonzero(column)}))
    rooms: list[int] = []
    fills: list[dict[int, int]] = []
    for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        n = int(left[j])
        for b, room in enumerate(rooms):
            k = min(n, room // sizes[j])
            if k:
                fills[b][j] = fills[b].get(j, 0) + k
                rooms[b] -= k * sizes[j]
                n -= k
        while n:
            k = min(n, capacity // sizes[j])
            fills.append({j: k})
            rooms.append(capacity - k * sizes[j])
            n -= k
    return plan + [(1, fill) for fill in fills]


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece a ``sequence_id`` and its ``offset`` there.

    ``pieces`` has ``length`` (1 to ``capacity``) and any other columns, which are kept; it
    should be a written table, as it is read more than once. Empty in, empty out.
    """
    spark = pieces.sparkSession
    grain = math.gcd(GRAIN, capacity)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    whole = [n for n in sorted(histogram) if n % grain == 0 and n < capacity]
    tails = [n for n in sorted(histogram) if n % grain]
    plan = []
    for lengths, unit in ((whole, grain), (tails, 1)):
        for times, p in plan_patterns([n // unit for n in lengths], [histogram[n] for n in lengths], capacity // unit):
            plan.append((times, {lengths[j]: k for j, k in p.items()}))
    if capacity in histogram:
        plan.append((histogram[capacity], {capacity: 1}))
    slots, taken, base = [], dict.fromkeys(histogram, 0), 0
    for times, pattern in plan:
        for length, k in pattern.items():
            slots.append((length, taken[length], taken[length] + times * k, base, k))
            taken[length] += times * k
        base += times
    # as many rows as the patterns have lengths: bounded by the number of lengths, not by the data
    slot_table = spark.createDataFrame(slots, "_class long, _from long, _to long, _base long, _each int")
    classed = pieces.withColumn("_class", F.col("length"))
    salts = max(1, -(-total // RANK_ROWS))
    salted = classed.withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)))
    counts = salted.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    by_salt = Window.partitionBy("_class").orderBy("_salt")
    before = counts.select("_class", "_salt", (F.sum("_n").over(by_salt) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_class", "_salt").orderBy(*pieces.columns)
    ranked = salted.withColumn("_in", F.row_number().over(within) - 1).join(before, ["_class", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_before", "_in", "_salt")
    placed = ranked.join(
        F.broadcast(slot_table.withColumnRenamed("_class", "_slot_class")),
        (F.col("_class") == F.col("_slot_class")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    )
    nth = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor(nth / F.col("_each")).cast("long"))
    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank")
    offset = F.sum("length").over(in_order) - F.col("length")
    return placed.select(*pieces.columns, "sequence_id", offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = 4096) -> DataFrame:
    """Pack all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are documents of the end id. Pieces of one length are interchangeable.
    """
    return pack(cut_lineage(cut_pieces(docs, tokenizer, end, capacity), "pieces"), capacity)
