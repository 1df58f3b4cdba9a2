"""Hard negatives: rows of another label whose score lies in a window below a positive's score.

Candidates are laid out along a Hilbert curve over the dimensions that vary most, and written
as Parquet blocks of BLOCK_ROWS rows with zone maps: the least and greatest value of every
dimension, and of the label. Consecutive blocks are a zone with maps of its own. For an anchor a
and a block, interval arithmetic bounds every inner product: from the sum of the smaller of
``a_i low_i`` and ``a_i high_i`` to that of the larger. A block is read for an anchor only if
this interval meets one of the anchor's windows, which narrow as results are found.

An anchor first searches the zone it lies in, and then goes to the other zones that its windows
leave. Positives are the window without ends among rows of its label; from them follow the
windows of negatives. Every result is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.vectorsets import matrix
from reviewmill.session import cut_lineage

CURVE_DIMENSIONS = 8
CURVE_BITS = 4
BLOCK_ROWS = 512
ZONE_BYTES = 8 << 20
MOST_ZONES = 4096
MAP_VALUES = 1 << 21
SAMPLE = 20_000
ANCHORS_PER_TASK = 2048
EXACT = float(1 << 52)
TOP = (1 << 62) - 1
NONE = -(1 << 63) + 1
BLOCKS = "zone long, part long, block long, label_low long, label_high long, low array<long>, high array<long>, ids binary, labels binary, rows binary"
HITS = "anchor_id long, w int, id long, score long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (whole numbers below ``2 ** bits``, a column per dimension) on the Hilbert curve.

    Level by level from the top, a dimension's bit says whether the cube below it is mirrored in
    the first dimension or swapped with it; the Gray code of what results, read across the
    dimensions, is the place.
    """
    x = points.T.astype(np.uint64)
    for level in reversed(range(1, bits)):
        bit, rest = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            mirrored = (x[i] & bit) != 0
            swap = np.where(mirrored, np.uint64(0), (x[0] ^ x[i]) & rest)
            x[0] ^= np.where(mirrored, rest, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.uint64)
    for level in reversed(range(1, bits)):
        turned ^= np.where(x[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turned
    key = np.zeros(x.shape[1], np.uint64)
    for level in reversed(range(bits)):
        for i in range(len(x)):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return key


class Layout:
    """The curve over a sample's most varied dimensions, each cut at its quantiles, and the
    keys at which zones begin."""

    def __init__(self, sample: np.ndarray, zones: int):
        self.axes = np.sort(np.argsort(-sample.var(axis=0), kind="stable")[:CURVE_DIMENSIONS])
        steps = np.arange(1, 1 << CURVE_BITS) / (1 << CURVE_BITS)
        self.cuts = [np.quantile(sample[:, a], steps) for a in self.axes]
        self.starts = np.empty(0, np.uint64)
        keys = np.sort(self.keys(sample))
        self.starts = np.unique(keys[(np.arange(1, zones) * len(keys)) // zones])

    def keys(self, rows: np.ndarray) -> np.ndarray:
        levels = [np.searchsorted(cut, rows[:, a], side="right") for a, cut in zip(self.axes, self.cuts, strict=True)]
        return hilbert_keys(np.stack(levels, axis=1), CURVE_BITS)

    def zones(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, keys, side="right").astype(np.int64)


def interval(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point of each box."""
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    low, high = low.astype(float).T, high.astype(float).T
    return up @ low + down @ high, up @ high + down @ low


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact; beyond 62 bits they saturate."""
    size = float(np.abs(anchors.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * anchors.shape[1]
    if size < EXACT:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    if size < TOP:
        return anchors @ rows.T
    whole = anchors.astype(object) @ rows.astype(object).T
    return np.clip(whole, -TOP, TOP).astype(np.int64)


@dataclass
class Anchors:
    """Anchors at hand: ids, labels, vectors and, per anchor, windows of scores (a row of lows and
    of highs; an empty window has its low above its high)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, width: int) -> Anchors:
        lows, highs = table.column("lows").to_pylist(), table.column("highs").to_pylist()
        windows = max(map(len, lows), default=0)
        low, high = np.full((len(lows), windows), TOP, np.int64), np.full((len(lows), windows), NONE, np.int64)
        for i, (a, b) in enumerate(zip(lows, highs, strict=True)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        return cls(table.column("anchor_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v"), width, np.int64), low, high)

    def meeting(self, low: np.ndarray, high: np.ndarray, labels: np.ndarray, same: bool, floors: np.ndarray | None = None) -> np.ndarray:
        """Whether a box (last axis) may hold a row for an anchor (first axis) and a window. ``labels``
        are the least and greatest label of each box."""
        least, most = interval(self.vectors, low, high)
        scale = np.abs(self.vectors).astype(float).sum(axis=1)[:, None] * np.maximum(np.abs(low), np.abs(high)).astype(float).max(axis=1)[None, :]
        slack = np.where(scale < EXACT, 0.0, 1e-9 * scale + 1)  # sums beyond 2^52 are rounded
        of = self.labels[:, None]
        fits = (labels[0] <= of) & (of <= labels[1]) if same else (labels[0] != of) | (labels[1] != of)
        floors = self.lows if floors is None else floors
        inside = ((most + slack)[:, None, :] >= floors[:, :, None]) & ((least - slack)[:, None, :] <= self.highs[:, :, None])
        return inside & fits[:, None, :] & (self.lows <= self.highs)[:, :, None]


def best_in_windows(anchors: Anchors, blocks: list[dict], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores (anchor, window, place) of the ``k`` highest scores in each window, ties to
    the smaller id, and the number of rows that were scored. Unused places have score NONE."""
    shape = (*anchors.lows.shape, k)
    ids, scores, read = np.full(shape, TOP, np.int64), np.full(shape, NONE, np.int64), 0
    low, high = (np.array([b[c] for b in blocks], np.int64) for c in ("low", "high"))
    labels = np.array([[b["label_low"] for b in blocks], [b["label_high"] for b in blocks]])
    promising = np.argsort(-interval(anchors.vectors, low, high)[1].mean(axis=0), kind="stable")
    for b in promising.tolist():
        block = blocks[b]
        floors = np.maximum(anchors.lows, scores[:, :, -1])
        meets = anchors.meeting(low[b : b + 1], high[b : b + 1], labels[:, b : b + 1], same, floors)[:, :, 0]
        going = np.flatnonzero(meets.any(axis=1))
        if not len(going):
            continue
        own = products(anchors.vectors[going], block["rows"])
        read += own.size
        fits = (block["labels"][None, :] == anchors.labels[going][:, None]) == same
        fits &= block["ids"][None, :] != anchors.ids[going][:, None]
        for w in range(shape[1]):
            mine = np.flatnonzero(meets[going, w])
            to = going[mine]
            inside = fits[mine] & (own[mine] >= floors[to, w][:, None]) & (own[mine] <= anchors.highs[to, w][:, None])
            some = inside.any(axis=1)
            if not some.any():
                continue
            mine, to = mine[some], to[some]
            left = np.where(inside[some], own[mine], NONE)
            new_ids, new_scores, row = [ids[to, w]], [scores[to, w]], np.arange(len(to))
            for _ in range(min(k, left.shape[1])):
                at = left.argmax(axis=1)  # of equal scores the first, which has the smallest id
                score = left[row, at]
                new_ids.append(np.where(score > NONE, block["ids"][at], TOP)[:, None])
                new_scores.append(score[:, None])
                left[row, at] = NONE
            both_ids, both = np.concatenate(new_ids, axis=1), np.concatenate(new_scores, axis=1)
            order = np.lexsort((both_ids, -both), axis=-1)[:, :k]
            ids[to, w], scores[to, w] = np.take_along_axis(both_ids, order, 1), np.take_along_axis(both, order, 1)
    return ids, scores, read


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a part of a zone as blocks along the curve; in a block they are in order of id."""
    zone, part = (k.as_py() for k in key)
    rows = np.asarray(table.column("v").combine_chunks().flatten().to_numpy(), np.int64).reshape(table.num_rows, -1)
    ids, labels, keys = (table.column(c).to_numpy() for c in ("id", "label", "place"))
    order, out = np.lexsort((ids, keys)), []
    for block, start in enumerate(range(0, len(order), BLOCK_ROWS)):
        held = order[start : start + BLOCK_ROWS]
        held = held[np.argsort(ids[held], kind="stable")]
        low, high = rows[held].min(axis=0), rows[held].max(axis=0)
        out.append((zone, part, block, labels[held].min(), labels[held].max(), low, high, *(x[held].astype("<i8").tobytes() for x in (ids, labels, rows))))
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 3
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), kinds, strict=True)})


def _unpacked(blocks: pa.Table, width: int) -> list[dict]:
    out = []
    for block in blocks.select(["label_low", "label_high", "low", "high", "ids", "labels", "rows"]).to_pylist():
        for name in ("ids", "labels", "rows"):
            block[name] = np.frombuffer(block[name], "<i8")
        block["rows"] = block["rows"].reshape(-1, width)
        out.append(block)
    return out


def _meet(index: DataFrame, visits: DataFrame, search, schema: str) -> DataFrame:  # noqa: ANN001
    """``search(blocks, anchors)`` for every part of a zone and the anchors that visit it, which are
    dealt to several tasks where they are more than ANCHORS_PER_TASK."""
    visits = cut_lineage(visits, "zone-visits")
    counts = visits.groupBy("zone", "part").agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.select("zone", "part", F.ceil(F.col("_n") / ANCHORS_PER_TASK).cast("int").alias("_shares"))
    left = index.join(shares, ["zone", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    right = visits.join(shares, ["zone", "part"]).withColumn("share", F.pmod(F.xxhash64("anchor_id"), "_shares").cast("int"))
    left = left.select(*[F.col(c).alias(f"b_{c}" if c in ("zone", "part", "share") else c) for c in (*index.columns, "share")])
    right = right.select(*visits.columns, "share")
    return left.groupBy("b_zone", "b_part", "b_share").cogroup(right.groupBy("zone", "part", "share")).applyInArrow(search, schema)


class Candidates:
    """The written blocks of all rows of one width, and the zone maps above them."""

    def __init__(self, valid: DataFrame, width: int, n: int):
        self.width = width
        zone_rows = max(BLOCK_ROWS, ZONE_BYTES // (8 * width))
        zones = max(1, min(MOST_ZONES, MAP_VALUES // width, -(-n // zone_rows)))
        sample = matrix(valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v"), width)
        layout = Layout(sample, zones)

        def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = layout.keys(matrix(batch.column("v"), width))
                extra = [pa.array(keys.astype(np.int64)), pa.array(layout.zones(keys))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "place", "zone"])

        schema = "id long, label long, v array<long>, anchor boolean, place long, zone long"
        rows = cut_lineage(valid.select("id", "label", "v", "anchor").mapInArrow(placed, schema), "placed")
        counts = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).orderBy("zone").collect()  # MOST_ZONES at most
        self.zones = np.array([c["zone"] for c in counts], np.int64)
        self.parts = np.array([-(-c["n"] // zone_rows) for c in counts], np.int64)
        parts = F.broadcast(valid.sparkSession.createDataFrame(list(zip(self.zones.tolist(), self.parts.tolist(), strict=True)), "zone long, parts long"))
        # rows of one place, however many, are dealt to the parts of their zone
        self.rows = rows.join(parts, "zone").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
        packed = self.rows.groupBy("zone", "part").applyInArrow(_packed, BLOCKS)
        self.blocks = cut_lineage(packed.sortWithinPartitions("zone", "part", "block"), "blocks")
        self._read_maps()

    def _read_maps(self) -> None:
        ends = [F.min("label_low").alias("a"), F.max("label_high").alias("b")]
        labels = self.blocks.groupBy("zone").agg(*ends).orderBy("zone").collect()
        each = self.blocks.select("zone", F.posexplode(F.arrays_zip("low", "high")).alias("i", "e"))
        found = each.groupBy("zone", "i").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).orderBy("zone", "i").toArrow()
        self.low, self.high = (found.column(c).to_numpy().reshape(-1, self.width) for c in ("low", "high"))
        self.labels = np.array([[r["a"] for r in labels], [r["b"] for r in labels]])

    def hits(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchor_id, w, id, score, rank`` of the ``k`` highest scores in window ``w``, ties to the smaller id.

        ``asked`` has ``anchor_id, label, v, zone, part, lows, highs``; rows are of the anchor's label if
        ``same``, else of others, and never of its own id.
        """
        width, zones, parts = self.width, self.zones, self.parts
        low, high, labels = self.low, self.high, self.labels

        def search(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
            columns: list = [[]] * 4
            if blocks.num_rows and anchors.num_rows:
                held = Anchors.of(anchors, width)
                ids, scores, _ = best_in_windows(held, _unpacked(blocks, width), k, same)
                a, w, at = np.nonzero(scores > NONE)
                columns = [held.ids[a], w, ids[a, w, at], scores[a, w, at]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])

        def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    to_zone = Anchors.of(part, width).meeting(low, high, labels, same).any(axis=1)
                    which, to = np.nonzero(to_zone)
                    which, to = np.repeat(which, parts[to]), np.repeat(to, parts[to])
                    nth = np.arange(len(to)) - np.searchsorted(which * len(zones) + to, which * len(zones) + to)
                    other = (zones[to] != part.column("zone").to_numpy()[which]) | (nth != part.column("part").to_numpy()[which])
                    rest = part.select(["anchor_id", "label", "v", "lows", "highs"]).take(pa.array(which[other]))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(zones[to[other]]), pa.array(nth[other])], names=[*rest.schema.names, "zone", "part"])

        asked = cut_lineage(asked.select("anchor_id", "label", "v", "lows", "highs", "zone", "part"), "asked")
        home = cut_lineage(_meet(self.blocks, asked, search, HITS), "zone-hits")
        full = home.groupBy("anchor_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
        floors = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("floors"))
        floor = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("floors", i), x)))
        narrowed = asked.join(floors, "anchor_id", "left").withColumn("lows", floor)
        going = narrowed.select(*asked.columns).mapInArrow(visits, asked.schema)
        found = home.unionByName(_meet(self.blocks, going, search, HITS))
        order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def mine(self, positives: int, negatives: int, low: int, high: int) -> DataFrame:
        ends = [F.array(F.lit(x).cast("long")).alias(c) for x, c in ((-TOP, "lows"), (TOP, "highs"))]
        anchors = self.rows.where("anchor").select(F.col("id").alias("anchor_id"), "label", "v", "zone", "part")
        anchors = cut_lineage(anchors, "anchors")
        found = cut_lineage(self.hits(anchors.select("*", *ends), positives, same=True), "positives")
        score = F.col("score").cast("decimal(20,0)")
        bounds = F.struct("rank", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
        listed = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(bounds)).alias("b"))
        asked = anchors.join(listed.select("anchor_id", F.col("b.low").alias("lows"), F.col("b.high").alias("highs")), "anchor_id")
        hits = self.hits(asked, negatives, same=False).select("anchor_id", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        known = found.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        return hits.join(known, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, key: str, vector: str, label: Column, value: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``value`` makes whole numbers of the double array ``x``; a score is the inner product with the
    anchor's. Each anchor (where ``is_anchor``) has its first ``positives`` other rows of its
    ``label``; for each of these come the first ``negatives`` rows of other labels with a score of
    ``low`` to ``high`` percent of the positive's. Higher scores come first, ties by smaller id.

    Rows with a null id or label, and vectors that are null, empty, or hold null or non-finite
    components take no part. Of several rows of one id the one with the smallest label, then
    vector, does. Vectors of different widths have no score: each width is searched by itself,
    one after the other. Scores saturate at 62 bits. Other columns are ignored; an empty table, or
    one without anchors, has no result.
    """
    inf = F.lit(float("inf"))
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: c + F.lit(0.0))
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0))
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)))
    first = rows.select("id", F.struct("label", value.alias("v")).alias("r"), "anchor").groupBy("id").agg(F.min("r").alias("r"), F.max("anchor").alias("anchor"))
    valid = cut_lineage(first.select("id", "r.label", "r.v", "anchor"), "valid")
    widths = valid.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("anchor").alias("asked")).where("asked").orderBy("w").collect()
    found = [Candidates(valid.where(F.size("v") == r["w"]), r["w"], r["n"]).mine(positives, negatives, low, high) for r in widths]
    return reduce(DataFrame.unionByName, found, vectors.sparkSession.createDataFrame([], MINED))
