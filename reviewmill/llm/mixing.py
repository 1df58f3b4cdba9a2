"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Words flow
from patterns to source quotas; the first use of a word is free, each repetition costs more
than the one before, so documents are repeated only where quotas demand it, evenly. Patterns
then turn their flow into documents: whole rounds for all, and one round more for those that
come first in a seeded order.

Only sums per pattern and per part of the seeded order reach the driver, never documents.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], cap: float, total: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what is cut off
    is shared by weight among the others until none is above."""
    targets, full = [0.0] * len(sizes), set()
    while True:
        rest = float(total) - sum(cap * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        for i in range(len(sizes)):
            targets[i] = float(cap * sizes[i]) if i in full else rest * weights[i] / weight if weight else 0.0
        over = {i for i in range(len(sizes)) if i not in full and targets[i] > cap * sizes[i]}
        if not over:
            return targets
        full |= over


def route(patterns: Sequence[tuple[frozenset, int]], quotas: dict, rounds: int) -> list[int]:
    """Words that each pattern gives: a minimum-cost flow from patterns to quotas.

    Every pattern has ``rounds`` arcs of its size, the k-th at cost k - 1; arcs to its sources
    are free. Successive shortest paths: at equal prices per round that is, round by round, a
    largest flow in the residual network; a flow once sent to a source may move to another.
    """
    given = [0] * len(patterns)
    sent: dict[tuple[int, object], int] = {}
    room = {s: int(round(q)) for s, q in quotas.items()}
    holders: dict[object, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        for s in members:
            holders.setdefault(s, []).append(p)
    for step in range(rounds):
        spare = [size for _, size in patterns]
        for p, (members, _) in enumerate(patterns):
            for s in sorted(members, key=str):  # direct paths first
                k = min(spare[p], room.get(s, 0))
                spare[p] -= k
                room[s] = room.get(s, 0) - k
                given[p] += k
                sent[p, s] = sent.get((p, s), 0) + k
        # then paths that push words of another pattern from one source to the next
        for p in range(len(patterns)):
            while spare[p] and len(patterns[p][0]):
                came: dict[object, tuple] = {s: (p, None) for s in patterns[p][0]}
                queue, end = deque(came), None
                while queue and end is None:
                    s = queue.popleft()
                    if room.get(s, 0) > 0:
                        end = s
                        break
                    for other in holders[s]:
                        if sent.get((other, s), 0) > 0:
                            for t in patterns[other][0]:
                                if t not in came:
                                    came[t] = (other, s)
                                    queue.append(t)
                if end is None:
                    break
                path, s = [], end
                while s is not None:
                    via, back = came[s]
                    path.append((via, back, s))
                    s = back
                k = min([spare[p], room[end]] + [sent[via, back] for via, back, _ in path if back is not None])
                for via, back, s in path:
                    sent[via, s] = sent.get((via, s), 0) + k
                    if back is not None:
                        sent[via, back] -= k
                room[end] -= k
                spare[p] -= k
                given[p] += k
    return given


def _cut(rows: DataFrame, wanted: dict[int, int], level: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Where, in the seeded order of each pattern, ``wanted`` words are reached: the bucket, and
    the words still wanted inside of it. Sums are per bucket, so no task holds a pattern."""
    spark = rows.sparkSession
    sums = rows.groupBy("_pattern", F.col(f"_b{level}").alias("_b")).agg(F.sum("size").alias("_s"))
    running = F.sum("_s").over(Window.partitionBy("_pattern").orderBy("_b"))
    table = spark.createDataFrame([(p, w) for p, w in wanted.items()] or [(-1, 0)], "_pattern int, _want long")
    reached = sums.withColumn("_run", running).join(F.broadcast(table), "_pattern").where("_run - _s <= _want and _run > _want")
    return reached, {r["_pattern"]: (r["_b"], r["_want"] - r["_run"] + r["_s"]) for r in reached.collect()}


def mix(docs: DataFrame, members: str, weights: dict, seed: int = 17, rounds: int = 3) -> DataFrame:
    """Documents with how often each is used.

    ``docs`` has ``size`` (words, long) and the array column ``members`` of sources; further
    columns are kept. It should be a written table, as it is read several times. ``weights``
    are shares by source. Added: ``pattern_size``, ``rounds`` (times used) and ``taken``.
    A document without members, or without words, is used zero times. Equal rows have the same
    place in the seeded order and are used alike up to the last one reached.
    """
    spark = docs.sparkSession
    key = F.array_sort(F.array_distinct(F.col(members)))
    sums = docs.groupBy(key.alias("_members")).agg(F.sum("size").alias("n")).collect()
    patterns = [(frozenset(r["_members"] or ()), int(r["n"] or 0)) for r in sums]
    held: dict[object, int] = {}
    for names, n in patterns:
        for s in names:
            held[s] = held.get(s, 0) + n
    ordered = sorted(weights, key=str)
    total = sum(n for _, n in patterns)
    quotas = water_fill([held.get(s, 0) for s in ordered], [weights[s] for s in ordered], rounds, total)
    given = route(patterns, dict(zip(ordered, quotas, strict=True)), rounds)
    plan, wanted = [], {}
    for p, ((_, n), words) in enumerate(zip(patterns, given, strict=True)):
        whole, rest = (words // n, words % n) if n else (0, 0)
        plan.append((sums[p]["_members"], p, n, whole))
        wanted[p] = rest
    plan_table = spark.createDataFrame(plan or [([], -1, 0, 0)], f"_members {docs.select(key.alias('k')).dtypes[0][1]}, _pattern int, pattern_size long, _whole long")
    order = F.xxhash64(F.lit(seed), *[c for c in docs.columns if c != members])
    rows = docs.withColumn("_members", F.coalesce(key, F.array())).withColumn("_h", order)
    rows = rows.withColumn("_b1", F.shiftrightunsigned("_h", 52)).withColumn("_b2", F.shiftrightunsigned(F.shiftleft("_h", 12), 52))
    plan_table = plan_table.withColumn("_members", F.coalesce("_members", F.array()))
    rows = rows.join(F.broadcast(plan_table), "_members").drop("_members")
    _, first = _cut(rows, wanted, 1)
    edge1 = spark.createDataFrame([(p, b, w) for p, (b, w) in first.items()] or [(-1, 0, 0)], "_pattern int, _e1 long, _w1 long")
    rows = rows.join(F.broadcast(edge1), "_pattern", "left")
    inner = rows.where(F.col("_b1") == F.col("_e1"))
    _, second = _cut(inner, {p: w for p, (_, w) in first.items()}, 2)
    edge2 = spark.createDataFrame([(p, b, w) for p, (b, w) in second.items()] or [(-1, 0, 0)], "_pattern int, _e2 long, _w2 long")
    rows = rows.join(F.broadcast(edge2), "_pattern", "left")
    on_edge = (F.col("_b1") == F.col("_e1")) & (F.col("_b2") == F.col("_e2"))
    before = F.coalesce(F.col("_b1") < F.col("_e1"), F.lit(False)) | F.coalesce((F.col("_b1") == F.col("_e1")) & (F.col("_b2") < F.col("_e2")), F.lit(False))
    # the rows of one edge bucket: a 2^24th of a pattern and copies of one row
    last = Window.partitionBy("_pattern").orderBy("_h", *[c for c in docs.columns if c != members])
    edge = rows.where(F.coalesce(on_edge, F.lit(False))).withColumn("_run", F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("_more", (F.col("_run") - F.col("size") / 2 <= F.col("_w2")).cast("long")).drop("_run")
    rest = rows.where(~F.coalesce(on_edge, F.lit(False))).withColumn("_more", before.cast("long"))
    used = rest.unionByName(edge).withColumn("rounds", F.when(F.col("size") > 0, F.col("_whole") + F.col("_more")).otherwise(F.lit(0)))
    return used.withColumn("taken", F.col("rounds") * F.col("size")).select(*docs.columns, "pattern_size", "rounds", "taken")


def mix_by_source(docs: DataFrame, source: str, weights: Sequence[float], rounds: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Mix documents of one source each, with ``weights`` repeating over the sources by code point,
    null last. Returns the mixed documents and a table ``_source, source_size, target`` with one
    row per source."""
    spark = docs.sparkSession
    sums = docs.groupBy(source).agg(F.sum("size").alias("n")).collect()
    sizes = sorted(((r[source], int(r["n"] or 0)) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    shares = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    targets = water_fill([n for _, n in sizes], shares, rounds, sum(n for _, n in sizes))
    name = lambda s: "null" if s is None else f"={s}"
    by_name = {name(s): w for (s, _), w in zip(sizes, shares, strict=True)}
    members = F.array(F.when(F.col(source).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(source))))
    mixed = mix(docs.withColumn("_sources", members), "_sources", by_name, seed, rounds).drop("_sources")
    rows = [(s, n, t) for (s, n), t in zip(sizes, targets, strict=True)]
    return mixed, spark.createDataFrame(rows, "_source string, source_size long, target double")
