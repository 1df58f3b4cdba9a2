"""Similarity join of word n-gram sets (Jaccard) by vertical partitioning.

The global order of all n-grams (rarest first) is cut into fragments by the n-gram's hash, and
every set into one segment per fragment.

1. Tasks send segments to their fragments. A fragment knows how many sets hold each of its
   n-grams and answers with those that two sets or more hold; only these can overlap.
2. A set that shares too few n-grams to reach the threshold with anything is done. For the rest
   the n-grams at the front of the order (as many as the threshold demands) are postings: two
   similar sets meet in one of them, and from their first common one on hold enough n-grams.
3. Within a posting list the sets first meet a leader instead of each other. What is close to
   the leader is linked through it. One minus Jaccard is a metric, so a pair whose distances to
   the leader differ by more than the threshold allows cannot be similar. Only pairs that this
   leaves, and that no links connect yet, are compared directly.
4. Candidate pairs are counted fragment by fragment, from segments that each hold a part of
   every set, and the partial overlaps are summed per pair.
5. Links are joined into components by alternating stars.

Every step is exact; equal sets are one set from the start. An n-gram is known by a hash of 48
bits and its fragment's number; sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.words import WordValues, batches_of, bound_batches, freeing, segments
from reviewmill.operators.joins import hot_keys, lookup_join
from reviewmill.session import cut_lineage

FRAGMENT_NGRAMS = 1 << 21
LEAST_FRAGMENTS = 32
MOST_FRAGMENTS = 1 << 15
LOCALLY_HOT = 8
BATCH_BYTES = 8 << 20
BATCH_SETS = 1 << 15
PAIRS_PER_TASK = 1 << 20
LEADER_ROUNDS = 4
DIRECT_PER_POSTING = 512
EARLIER = 4
LOW48 = np.uint64((1 << 48) - 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


class Shingles:
    """Sets of hashed word n-grams of whole texts."""

    def __init__(self, n: int):
        self.n = n
        self.words = WordValues(word_hashes)

    def of(self, text: bytes) -> np.ndarray:
        """The sorted distinct n-grams; with fewer than ``n`` words, all words as one n-gram."""
        parts = [self.words.of(s.split()) for s in segments(text.lower())]
        hashes = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if not len(hashes):
            return np.empty(0, np.uint64)
        n = min(self.n, len(hashes))
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def set_key(ngrams: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(ngrams.tobytes())
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, h1, h2`` per row; the keys of an empty set are null."""

    def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch, texts in batches_of(batches, "text"):
            sets = [shingles.of(text) for text in texts]
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                names=["doc_id", "text_key", "n_shingles", "h1", "h2"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return bound_batches(keyed).mapInArrow(freeing(sized), "doc_id long, text_key long, n_shingles long, h1 long, h2 long")


def _blobs(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


SENT = "fragment int, batch long, kind int, a binary, b binary, c binary, d binary"
ANSWERED = "batch long, kind int, fragment int, a binary, b binary, c binary, d binary"
SEGMENT, SETS, HOT = 0, 1, 2
MOST_HELD = (1 << 16) - 1  # the order does not tell n-grams of more sets apart by their number


def _packed(ids: np.ndarray) -> bytes:
    """The low 48 bits of n-grams, six bytes each."""
    return ids.astype(np.uint32).tobytes() + (ids >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(data: bytes, fragment: int) -> np.ndarray:
    n = len(data) // 6
    ids = np.frombuffer(data, np.uint32, n).astype(np.uint64)
    ids |= np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)
    return ids | (np.uint64(fragment) << np.uint64(48))


def _send(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Segments of all sets, one row per fragment and batch of documents.

    Equal sets of a batch are sent once. An n-gram held by more than LOCALLY_HOT sets of a batch
    is sent as a count, so a common passage is no more than that per batch to its fragments;
    which sets hold it waits in the batch's own row.
    """

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, number = Shingles(n), TaskContext.get().partitionId() << 32
        for _, texts in batches_of(batches, "text", BATCH_BYTES):
            for at in range(0, len(texts), BATCH_SETS):
                known: dict[tuple[int, int], np.ndarray] = {}
                for text in texts[at : at + BATCH_SETS]:
                    ngrams = shingles.of(text)
                    if len(ngrams):
                        known.setdefault(set_key(ngrams), ngrams)
                if known:
                    yield _blobs(_segments(number, known, bits), SENT)
                    number += 1

    return bound_batches(docs).select("text").mapInArrow(freeing(sent), SENT)


def _segments(batch: int, known: dict[tuple[int, int], np.ndarray], bits: int) -> list[tuple]:
    sizes = np.array([len(s) for s in known.values()])
    ngrams = np.concatenate(list(known.values()))
    owners = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    order = np.argsort(ngrams)
    ordered = ngrams[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(starts, len(ngrams)))
    hot = counts > LOCALLY_HOT
    is_hot = np.empty(len(ngrams), bool)
    is_hot[order] = np.repeat(hot, counts)
    hot_owners = owners[order][np.repeat(hot, counts)]
    ids = lambda x: ((x >> np.uint64(64 - bits)) << np.uint64(48)) | (x & LOW48)
    hot_ids, hot_counts = ids(ordered[starts[hot]]), counts[hot].astype(np.uint32)
    keys = np.array(list(known), np.int64).T
    sets = np.concatenate([sizes.astype(np.int64), keys[0], keys[1]]).tobytes()
    rows = [(batch % (1 << bits), batch, SETS, sets, hot_ids.tobytes(), hot_counts.tobytes(), hot_owners.tobytes())]
    cool, cool_owners = ngrams[~is_hot], owners[~is_hot]
    fragment = (cool >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(fragment, kind="stable")  # within a fragment the sets stay in order
    cool, cool_owners, fragment = cool[order] & LOW48, cool_owners[order], fragment[order]
    cuts = np.searchsorted(fragment, np.arange((1 << bits) + 1))
    hot_cuts = np.searchsorted(hot_ids >> np.uint64(48), np.arange((1 << bits) + 1, dtype=np.uint64))
    for f in range(1 << bits):
        a, b, x, y = cuts[f], cuts[f + 1], hot_cuts[f], hot_cuts[f + 1]
        if b > a or y > x:
            held = np.bincount(cool_owners[a:b], minlength=len(sizes)).astype(np.uint32)
            rows.append((f, batch, SEGMENT, _packed(cool[a:b]), held.tobytes(), hot_ids[x:y].tobytes(), hot_counts[x:y].tobytes()))
    return rows


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """What a fragment knows, per batch: its shared n-grams, their owners and in how many sets
    each lies."""
    fragment = key[0].as_py()
    out, rows, cool, hot, hot_counts = [], [], [], [], []
    for batch, kind, a, b, c, d in zip(*(table.column(n).to_pylist() for n in ("batch", "kind", "a", "b", "c", "d")), strict=True):
        if kind == SETS:
            out.append((batch, SETS, fragment, a, b, c, d))
            continue
        cool.append(_unpacked(a, fragment))
        hot.append(np.frombuffer(c, np.uint64))
        hot_counts.append(np.frombuffer(d, np.uint32))
        held = np.frombuffer(b, np.uint32)
        rows.append((batch, len(cool[-1]), len(hot[-1]), np.repeat(np.arange(len(held), dtype=np.uint16), held)))
    if rows:
        ngrams = np.concatenate(cool + hot)
        single = sum(r[1] for r in rows)
        weights = np.concatenate([np.ones(single, np.uint32), *hot_counts])
        order = np.argsort(ngrams)
        ordered = ngrams[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        held = np.minimum(np.add.reduceat(weights[order], starts, dtype=np.int64), MOST_HELD)
        df = np.empty(len(ngrams), np.uint16)
        df[order] = np.repeat(held, np.diff(np.append(starts, len(ngrams))))
        at, hot_at = 0, single
        for batch, n, n_hot, owners in rows:
            shared = np.flatnonzero(df[at : at + n] > 1)
            if len(shared):
                out.append((batch, SEGMENT, fragment, _packed(ngrams[at : at + n][shared] & LOW48), owners[shared].tobytes(), df[at : at + n][shared].tobytes(), None))
            if n_hot:
                out.append((batch, HOT, fragment, ngrams[hot_at : hot_at + n_hot].tobytes(), None, df[hot_at : hot_at + n_hot].tobytes(), None))
            at, hot_at = at + n, hot_at + n_hot
    return pa.Table.from_batches([_blobs(out, ANSWERED)])


def _shared_sets(percent: int):  # noqa: ANN202
    """Per batch: the sets that share enough n-grams, which are ordered rarest first, and how
    many of these are in the prefix."""

    def shared(table: pa.Table) -> pa.Table:
        ids, owners, dfs, hot_ids, hot_dfs = [], [], [], [np.empty(0, np.uint64)], [np.empty(0, np.uint16)]
        held = None
        for kind, fragment, a, b, c, d in zip(*(table.column(n).to_pylist() for n in ("kind", "fragment", "a", "b", "c", "d")), strict=True):
            if kind == SETS:
                sizes, h1, h2 = np.frombuffer(a, np.int64).reshape(3, -1)
                held = np.frombuffer(b, np.uint64), np.frombuffer(c, np.uint32), np.frombuffer(d, np.uint16)
            elif kind == SEGMENT:
                ids.append(_unpacked(a, fragment))
                owners.append(np.frombuffer(b, np.uint16))
                dfs.append(np.frombuffer(c, np.uint16))
            else:
                hot_ids.append(np.frombuffer(a, np.uint64))
                hot_dfs.append(np.frombuffer(c, np.uint16))
        known, known_df = np.concatenate(hot_ids), np.concatenate(hot_dfs)
        order = np.argsort(known)
        hot_df = known_df[order][np.searchsorted(known[order], held[0])] if len(held[0]) else known_df[:0]
        ids.append(np.repeat(held[0], held[1]))
        dfs.append(np.repeat(hot_df, held[1]))
        owners.append(held[2])
        ngrams, owner, df = np.concatenate(ids), np.concatenate(owners).astype(np.int64), np.concatenate(dfs)
        shares = np.bincount(owner, minlength=len(sizes))
        needed = -(-percent * sizes // 100)
        active = np.flatnonzero(shares >= needed)
        keep = np.isin(owner, active)
        ngrams, owner, df = ngrams[keep], owner[keep], df[keep]
        order = np.lexsort((ngrams, df, owner))
        offsets = np.concatenate([[0], np.cumsum(shares[active])]).astype(np.int32)
        return pa.table(
            {
                "h1": pa.array(h1[active], pa.int64()),
                "h2": pa.array(h2[active], pa.int64()),
                "n": pa.array(sizes[active], pa.int64()),
                "prefix": pa.array((shares - needed + 1)[active], pa.int32()),
                "ngrams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ngrams[order].astype(np.int64))),
            }
        )

    return shared


def candidate_sets(docs: DataFrame, keys: DataFrame, n: int, percent: int, total: int) -> DataFrame:
    """``set_id, n, prefix, ngrams`` of every distinct set that could be similar to another.

    ``keys`` maps ``h1, h2`` to ``set_id``; ``total`` n-grams decide the number of fragments.
    """
    fragments = min(MOST_FRAGMENTS, max(LEAST_FRAGMENTS, -(-total // FRAGMENT_NGRAMS)))
    bits = math.ceil(math.log2(fragments))
    answers = _send(docs, n, bits).groupBy("fragment").applyInArrow(_answer, ANSWERED)
    found = answers.groupBy("batch").applyInArrow(_shared_sets(percent), "h1 long, h2 long, n long, prefix int, ngrams array<long>")
    # a set of several batches comes once from each; which one stays does not matter
    once = found.withColumn("_nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("n"))).where("_nth = 1")
    return once.join(keys, ["h1", "h2"]).select("set_id", "n", "prefix", "ngrams")


def _count(key: tuple, segments_: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of pairs within one fragment. The n-grams of a pair's first set are
    marked once for all its partners."""
    a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    counts = np.zeros(len(a), np.int64)
    if segments_.num_rows and len(a):
        lists = segments_.column("part").combine_chunks()
        names = segments_.column("set_id").to_numpy()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        by_name = np.argsort(names)
        _, flat = np.unique(flat, return_inverse=True)
        marks = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.uint8)

        def place(ids: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(names[by_name], ids), len(names) - 1)
            return np.where(names[by_name][at] == ids, by_name[at], -1)

        pa_, pb = place(a), place(b)
        lengths = np.append(offsets[1:] - offsets[:-1], 0)
        firsts = np.append(offsets[:-1], 0)
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for start, stop in zip(starts, np.append(starts[1:], len(a)), strict=True):
            mine = pa_[start]
            if mine < 0:
                continue
            own = flat[offsets[mine] : offsets[mine + 1]]
            marks[own] = 1
            for low in range(start, stop, 4096):
                others = pb[low : min(low + 4096, stop)]
                n = lengths[others]
                ends = np.cumsum(n)
                if ends[-1]:
                    held = marks[flat[np.repeat(firsts[others] - ends + n, n) + np.arange(ends[-1])]]
                    sums = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
                    counts[low : low + len(others)] = sums[ends] - sums[ends - n]
            marks[own] = 0
    some = counts > 0
    return pa.table({"a": a[some], "b": b[some], "part": counts[some]})


def dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``h``, the part they are counted in: pairs of one first set stay together, as its
    segments then travel once, unless they are more than PAIRS_PER_TASK."""
    parts = max(1, -(-pairs.count() // PAIRS_PER_TASK))
    hot = hot_keys(pairs, ["a"], PAIRS_PER_TASK)
    share = F.pmod(F.xxhash64("b"), F.coalesce("_splits", F.lit(1)))
    return pairs.join(F.broadcast(hot), "a", "left").withColumn("h", F.pmod(F.xxhash64("a", share), F.lit(parts))).drop("_splits")


def overlaps(pairs: DataFrame, sets: DataFrame, bits_total: int = 48) -> DataFrame:
    """``pairs`` (``a, b, na, nb``, distinct) with ``overlap``: the n-grams both sets hold.

    Segments and pairs meet by fragment and by a part of the pairs, so that a task holds a
    bounded share of either; a segment goes only where a pair needs it.
    """
    sizes = sets.agg(F.sum(F.size("ngrams")).alias("n"), F.max(F.shiftright(F.array_max("ngrams"), 48)).alias("top")).first()
    total, top = int(sizes["n"] or 0), int(sizes["top"] or 0)
    cuts = max(2, min(top + 1, -(-total // (4 * FRAGMENT_NGRAMS))))
    wide = -(-(top + 1) // cuts)
    cuts = -(-(top + 1) // wide)
    placed = dealt(pairs)
    needed = placed.select(F.col("a").alias("set_id"), "h").unionByName(placed.select(F.col("b").alias("set_id"), "h")).distinct()
    fragment_of = lambda t: F.floor(F.shiftright(t, 48) / wide).cast("int")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(cuts - 1)), lambda f: F.struct(f.alias("f"), F.filter("ngrams", lambda t: fragment_of(t) == f).alias("part"))
    )
    cut = needed.join(sets.select("set_id", F.explode(each).alias("_s")), "set_id").select("h", "_s.f", "set_id", "_s.part").where(F.size("part") > 0)
    spread = placed.select(F.col("h").alias("ph"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("pf"), F.col("a").alias("a"), F.col("b").alias("b"))
    counted = cut.groupBy("h", "f").cogroup(spread.groupBy("ph", "pf")).applyInArrow(_count, "a long, b long, part long")
    summed = counted.groupBy("a", "b").agg(F.sum("part").alias("overlap"))
    return pairs.join(summed, ["a", "b"], "left").na.fill(0, ["overlap"])


def _long_enough(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _enough_left(n: Column, at: Column, m: Column, at_m: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` n-grams that first meet at places ``at`` and ``at_m`` of
    their orders have enough n-grams from there on."""
    return (100 + percent) * F.least(n - at, m - at_m) >= percent * (n + m)


def _pairs(rows: DataFrame, other: str, other_n: str) -> DataFrame:
    """Distinct pairs, the smaller id first."""
    mine = F.col("set_id") < F.col(other)
    return rows.select(
        F.least("set_id", other).alias("a"),
        F.greatest("set_id", other).alias("b"),
        F.when(mine, F.col("n")).otherwise(F.col(other_n)).alias("na"),
        F.when(mine, F.col(other_n)).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of similar sets that connect all similar sets.

    A leader round is followed by others while direct comparison would look at more than
    DIRECT_PER_POSTING pairs for each posting, up to LEADER_ROUNDS; the direct comparison of
    what is left is exact at any size.
    """
    reach = 1 - percent / 100
    similar = 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))
    front = F.posexplode(F.slice("ngrams", 1, F.col("prefix"))).alias("_i", "ngram")
    alone = F.col("n") - F.size("ngrams")  # n-grams that no other set holds come first
    postings = sets.select("set_id", "n", alone.alias("_alone"), "ngrams", front)
    before = F.slice("ngrams", F.greatest(F.col("_i") + 1 - EARLIER, F.lit(1)), F.least(F.col("_i"), F.lit(EARLIER)))
    postings = postings.select("set_id", "n", "ngram", (F.col("_alone") + F.col("_i")).alias("at"), before.alias("before"))
    lists = postings.groupBy("ngram").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    postings = cut_lineage(postings.join(lists.select("ngram"), "ngram"), "postings")
    open_ = postings.drop("before").withColumn("ball", F.lit(0)).withColumn("d", F.lit(None).cast("double")).withColumn("exact", F.lit(False))
    limit, found = DIRECT_PER_POSTING * open_.count(), None
    for turn in range(1, LEADER_ROUNDS + 1):
        # the set that comes to the n-gram first has the fewest rare ones, so it lies amid the others
        fresh = F.when(F.col("ball") == 0, F.struct("at", "n", "set_id"))
        leaders = open_.groupBy("ngram").agg(F.min(fresh).alias("_l")).where("_l is not null")
        led = open_.drop("d", "exact").join(leaders, "ngram", "left")
        led = cut_lineage(led.select("*", F.col("_l.set_id").alias("leader"), F.col("_l.n").alias("ln"), F.col("_l.at").alias("lat")).drop("_l"), "led")
        other = F.col("leader").isNotNull() & (F.col("leader") != F.col("set_id"))
        possible = _long_enough(F.col("n"), F.col("ln"), percent) & _enough_left(F.col("n"), F.col("at"), F.col("ln"), F.col("lat"), percent)
        counted = cut_lineage(overlaps(cut_lineage(_pairs(led.where(other & possible), "leader", "ln"), "pairs"), sets), "overlaps")
        new = counted.where(similar).select("a", "b")
        found = new if found is None else found.unionByName(new)
        away = led.withColumn("a", F.least("set_id", "leader")).withColumn("b", F.greatest("set_id", "leader")).join(counted.select("a", "b", "overlap"), ["a", "b"], "left")
        distance = F.when(F.col("set_id") == F.col("leader"), 0.0).when(F.col("overlap").isNotNull(), 1 - F.col("overlap") / (F.col("n") + F.col("ln") - F.col("overlap")))
        bound = 1 - F.least("n", "ln") / F.greatest("n", "ln")  # not measured: their lengths give a lower bound
        inside = F.coalesce(100 * F.col("overlap") >= percent * (F.col("n") + F.col("ln") - F.col("overlap")), F.col("set_id") == F.col("leader"))
        away = away.select("ngram", "set_id", "n", "at", "ball", F.coalesce(distance, bound).alias("d"), distance.isNotNull().alias("exact"), F.coalesce(inside, F.lit(False)).alias("_in"))
        nearest = away.groupBy("ngram").agg(F.min(F.when(~F.col("_in"), F.col("d"))).alias("_out"), F.count(F.when(~F.col("_in") & F.col("d").isNull(), 1)).alias("_unknown"))
        nearest = nearest.where("_out is not null or _unknown > 0")
        reached = (F.col("_unknown") > 0) | (F.col("d") >= F.col("_out") - reach - 1e-9)
        kept = away.join(nearest, "ngram").where(~F.col("_in") | reached)
        kept = kept.withColumn("ball", F.when(F.col("_in") & (F.col("ball") == 0), F.lit(turn)).otherwise(F.col("ball")))
        open_ = cut_lineage(kept.select("ngram", "set_id", "n", "at", "ball", "d", "exact"), "open")
        sides = open_.groupBy("ngram").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("ball") == 0, 1)).alias("free"), F.countDistinct("ball").alias("balls"))
        work = sides.where("free > 0 or balls > 1").agg(F.sum(F.col("m") * F.col("m") / 2).alias("w")).first()["w"] or 0
        if work <= limit:
            break
    known = components(found)
    member = F.coalesce("component", "set_id").alias("component")
    open_ = open_.join(known, F.col("set_id") == F.col("node"), "left").select(*open_.columns, member)
    open_ = cut_lineage(open_.join(postings.select("ngram", "set_id", "before"), ["ngram", "set_id"]), "open")
    y = open_.select("ngram", *[F.col(c).alias(f"{c}_2") for c in open_.columns if c != "ngram"])
    apart = (F.col("component") != F.col("component_2")) & ((F.col("ball") == 0) | (F.col("ball") != F.col("ball_2")))
    metric = ~(F.col("exact") & F.col("exact_2")) | (F.abs(F.col("d") - F.col("d_2")) <= reach + 1e-9)
    possible = _long_enough(F.col("n"), F.col("n_2"), percent) & _enough_left(F.col("n"), F.col("at"), F.col("n_2"), F.col("at_2"), percent)
    # a pair that also meets one of its n-grams before is left to that one
    first = ~F.coalesce(F.arrays_overlap("before", "before_2"), F.lit(False))
    rest = open_.join(y, "ngram").where((F.col("set_id") < F.col("set_id_2")) & apart & metric & possible & first)
    counted = overlaps(cut_lineage(_pairs(rest, "set_id_2", "n_2"), "pairs"), sets)
    return found.unionByName(counted.where(similar).select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest id reachable, for every id in ``edges`` (``a, b``).

    Alternating stars: every node hands its larger neighbours to its smallest one, then its
    smaller ones; the edges shrink to one star per component. Ends when nothing changes.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, text_key, n_shingles, group, component_id`` for every row of ``docs`` (``doc_id, text``).

    Words are runs of other than space and U+0009 to U+000D, A-Z in lower case. Two documents
    link when ``100 * |intersection| >= percent * |union|`` of their sets of ``n`` words;
    ``component_id`` is the smallest ``doc_id`` reachable, ``group`` a number of the component.
    A document without words links with nothing: it is its own component, without a group. Rows
    without a ``doc_id`` link with nothing and have neither. Repeated rows are returned as often
    as they come; texts under one ``doc_id`` are looked at one by one, told apart by
    ``text_key``, the xxhash64 of the text.
    """
    rows = cut_lineage(document_sets(docs, n), "sets")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    total = named.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    least = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    keys = cut_lineage(least.withColumn("set_id", F.monotonically_increasing_id()), "set-ids")
    sets = cut_lineage(candidate_sets(docs, keys, n, percent, total), "candidate-sets")
    joined = components(links(sets, percent))
    # the root of a star is no node of its own edges
    found = keys.join(joined, F.col("set_id") == F.col("node"), "left").select("h1", "h2", "least", F.coalesce("component", "set_id").alias("_group"))
    first = found.groupBy(F.col("_group").alias("_g")).agg(F.min("least").alias("_first"))
    found = found.join(first, F.col("_group") == F.col("_g")).select("h1", "h2", "_group", "_first")
    named_id = F.col("doc_id").isNotNull()
    # copies of one text are split over tasks, and so are rows without words, whose keys are NULL
    return lookup_join(rows, found, ["h1", "h2"], "left", ["doc_id", "text_key"]).select(
        "doc_id", "text_key", "n_shingles", F.when(named_id, F.col("_group")).alias("group"), F.when(named_id, F.coalesce("_first", "doc_id")).alias("component_id")
    )


def first_of_groups(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest ``doc_id`` stays (of
    several texts under it the one with the smallest ``text_key``; of equal rows one). Rows
    without words, and rows without a ``doc_id``, stay."""
    found = similar_documents(docs.select("doc_id", "text"), n, percent)
    found = cut_lineage(found.select("doc_id", "text_key", "group"), "groups")
    firsts = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    alone = found.where(F.col("group").isNull() & F.col("doc_id").isNotNull()).select("doc_id", "text_key").distinct()
    kept = firsts.unionByName(alone).withColumn("_kept", F.lit(True))
    rows = found.where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_n"))
    flagged = rows.join(kept, ["doc_id", "text_key"], "left").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_n", "_kept")
    keys, spread = ["_id", "_key"], ["_key"]
    flagged = cut_lineage(flagged.where("_kept is null or _n > 1"), "leaving")
    named = docs.withColumn("_id", F.col("doc_id")).withColumn("_key", F.xxhash64("text"))
    # texts meet the keys that leave; these are broadcast when their files are small
    rest = lookup_join(named, flagged.select(*keys), keys, "left_anti", spread).select(*docs.columns)
    again = flagged.where("_kept").select(*keys)
    if again.isEmpty():
        return rest
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_key"))
    once = lookup_join(named, again, keys, "left_semi", spread).withColumn("_nth", nth).where("_nth = 1")
    return rest.unionByName(once.select(*docs.columns))
