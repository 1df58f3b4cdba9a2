"""Duplicate removal in file order, by content hash and by external id.

A third of all rows may be copies of one text. So the first row of a group is found by an
aggregate (combined before the shuffle, never a window over the whole group), and flags
come back through the unique row key, never through the hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.joins import BROADCAST_FILE_BYTES, ROWS_PER_TASK, hot_keys, lookup_join, split_join
from reviewmill.operators.keyindex import StoredKeys, all_given
from reviewmill.session import cut_lineage

HASH_KEYS = ("organization_id", "content_hash")
EXTERNAL_KEYS = ("source_id", "external_id")
FILE_ORDER = ("path", "row_number")

PARALLEL_ROUNDS = 8


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row key (the ``order`` columns) of the first row of every key group."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")


def dedup_in_batch(
    rows: DataFrame, keys: Sequence[str] = HASH_KEYS, order: Sequence[str] = FILE_ORDER
) -> DataFrame:
    """Rows that are the first of their key group in file order."""
    return rows.join(first_rows(rows, keys, order), list(order), "left_semi")


def known_keys(rows: DataFrame, stored: DataFrame | StoredKeys, keys: Sequence[str]) -> DataFrame:
    """The keys of ``rows`` that are stored: never more than the rows have. An index is read in
    place; of a plain table the key columns are shuffled once, and nothing of it is written."""
    if isinstance(stored, StoredKeys):
        return stored.of(keys).known(rows)
    asked = rows.where(all_given(keys)).select(*keys).distinct()
    return asked.join(stored.where(all_given(keys)).select(*keys).distinct(), list(keys), "left_semi")


def already_stored(
    rows: DataFrame, stored: DataFrame | StoredKeys, keys: Sequence[str] = HASH_KEYS, order: Sequence[str] = FILE_ORDER
) -> DataFrame:
    """Rows whose key is already stored (for hashes: anywhere in the tenant)."""
    return _by_known_keys(rows, stored, keys, order, "left_semi")


def dedup_against_existing(
    rows: DataFrame, stored: DataFrame | StoredKeys, keys: Sequence[str] = HASH_KEYS, order: Sequence[str] = FILE_ORDER
) -> DataFrame:
    """Rows whose key is not stored yet; a NULL in the key never collides."""
    return _by_known_keys(rows, stored, keys, order, "left_anti")


def _by_known_keys(rows: DataFrame, stored: DataFrame | StoredKeys, keys: Sequence[str], order: Sequence[str], how: str) -> DataFrame:
    """Keys are asked for, counted and joined, so rows are made once, and written before that."""
    rows = cut_lineage(rows, "dedup-rows")
    return lookup_join(rows, known_keys(rows, stored, keys), keys, how, spread=order)


def dedup_external_id(
    rows: DataFrame,
    stored: DataFrame | StoredKeys | None = None,
    keys: Sequence[str] = EXTERNAL_KEYS,
    order: Sequence[str] = FILE_ORDER,
) -> DataFrame:
    """Rows without an external id, and the first unstored row of each (source, external id)."""
    given = rows.where(all_given(keys))
    firsts = first_rows(given, keys, order)
    row_key = list(order)
    repeated = given.select(*row_key).join(firsts, row_key, "left_anti")
    kept = rows.join(repeated, row_key, "left_anti")
    return kept if stored is None else dedup_against_existing(kept, stored, keys, order)


def _first_two(live: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``first, second`` rows (as structs of ``order``) of every key group; groups stay aggregates."""
    given = live.where(all_given(keys)).select(*keys, *order)
    firsts = given.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
    rest = given.join(firsts.select("first.*"), order, "left_anti")
    seconds = rest.groupBy(*keys).agg(F.min(F.struct(*order)).alias("second"))
    return firsts.join(seconds, keys, "left").select("first", "second")


def _by_pointers(live: DataFrame, hash_keys: list[str], external_keys: list[str], order: list[str]) -> DataFrame:
    """Rows (``order`` columns) that are surely accepted, along whole chains at once.

    A row that is first for both keys is accepted. A row that is first for one key and second for
    the other is accepted if the row before it there is not: it points to that row with the
    answer turned round. Pointers to pointers are joined until all lead to a first row or to one
    that waits for two others; each join doubles their reach.
    """
    row = F.struct(*order)
    pairs = [_first_two(live, keys, order) for keys in (hash_keys, external_keys)]
    first = [p.select("first.*").withColumn(f"_first{i}", F.lit(True)) for i, p in enumerate(pairs)]
    second = [p.where("second is not null").select("second.*", F.col("first").alias(f"_before{i}")) for i, p in enumerate(pairs)]
    seen = live.select(*order, all_given(external_keys).alias("_given"))
    for part in (*first, *second):
        seen = seen.join(part, order, "left")
    first0, first1 = F.col("_first0").isNotNull(), F.col("_first1").isNotNull() | ~F.col("_given")
    target = F.when(first0 & F.col("_before1").isNotNull(), F.col("_before1")).when(first1 & F.col("_before0").isNotNull(), F.col("_before0"))
    # ``to`` NULL: the row is accepted itself, or waits for others (and then is not listed)
    state = seen.where((first0 & first1) | target.isNotNull()).select(row.alias("row"), F.when(~(first0 & first1), target).alias("to"), (~(first0 & first1)).alias("turned"))
    state = cut_lineage(state, "dedup-pointers")
    while True:
        ahead = state.select(F.col("row").alias("_row"), F.col("to").alias("_to"), F.col("turned").alias("_turned"), F.lit(True).alias("_found"))
        joined = state.join(ahead, F.col("to") == F.col("_row"), "left").where("to is null or _found")
        jumped = joined.select("row", F.when(F.col("to").isNotNull(), F.col("_to")).alias("to"), (F.col("turned") != F.coalesce("_turned", F.lit(False))).alias("turned"))
        state = cut_lineage(jumped, "dedup-pointers")
        if state.where("to is not null").isEmpty():
            return state.where(~F.col("turned")).select("row.*")


def ordered_dual_key_dedup(
    rows: DataFrame,
    stored: DataFrame | StoredKeys | None = None,
    hash_keys: Sequence[str] = HASH_KEYS,
    external_keys: Sequence[str] = EXTERNAL_KEYS,
    order: Sequence[str] = FILE_ORDER,
    rows_per_task: int = ROWS_PER_TASK,
    parallel_rounds: int = PARALLEL_ROUNDS,
    broadcast_bytes: int = BROADCAST_FILE_BYTES,
) -> DataFrame:
    """Row keys accepted when rows are taken one by one in file order.

    A row is accepted unless its hash or its external id was claimed by an accepted row (or
    is stored); a rejected row claims nothing. Seen as a graph with hashes and external ids
    as nodes and rows as edges this is the greedy matching in edge order, which rounds of
    parallel steps reproduce exactly: accept every live row that is first in both of its
    groups, drop the rows that share a key with one of those, repeat.

    A NULL in the hash key is a value of its own (rows without a tenant share one); a NULL in the
    external key means that none was given.

    Copies of one (hash, external id) pair collapse to their first row before the first
    round, so each round only sees distinct pairs. Removal splits hot keys over tasks. Long
    dependency chains are rare; where some remain after ``parallel_rounds``, further rounds
    settle whole chains by pointer jumping, in as many joins as the logarithm of their length.
    """
    hash_keys, external_keys, order = list(hash_keys), list(external_keys), list(order)
    pair = list(dict.fromkeys([*hash_keys, *external_keys]))
    live = rows.groupBy(*pair).agg(F.min(F.struct(*order)).alias("_row"))
    live = live.select(*pair, *[F.col(f"_row.{c}").alias(c) for c in order])
    if stored is not None:
        for keys in (hash_keys, external_keys):
            known = known_keys(live, stored, keys)
            live = lookup_join(live, known, keys, "left_anti", order, max_bytes=broadcast_bytes, rows_per_task=rows_per_task)
    # equality of structs takes NULL for a value
    live = cut_lineage(live.withColumn("_hash_key", F.struct(*hash_keys)), "dedup-live")
    hash_keys = ["_hash_key"]
    left = live.count()
    accepted: list[DataFrame] = []
    rounds = 0
    while left:
        rounds += 1
        if rounds > parallel_rounds:
            sure = _by_pointers(live, hash_keys, external_keys, order)
            winners = cut_lineage(live.join(sure, order, "left_semi"), "dedup-accepted")
        else:
            by_hash = live.groupBy(*hash_keys).agg(F.min(F.struct(*order, *external_keys)).alias("_w"))
            by_hash = by_hash.select(*hash_keys, *[F.col(f"_w.{c}").alias(c) for c in [*order, *external_keys] if c not in hash_keys])
            by_external = first_rows(live.where(all_given(external_keys)), external_keys, order)
            winners = cut_lineage(
                by_hash.where(~all_given(external_keys)).unionByName(
                    by_hash.where(all_given(external_keys)).join(by_external, order, "left_semi")
                ),
                "dedup-accepted",
            )
        accepted.append(winners.select(*order))
        for keys in (hash_keys, external_keys):
            taken = winners.where(all_given(keys)).select(*keys)
            if left > rows_per_task:
                hot = hot_keys(live.where(all_given(keys)), keys, rows_per_task)
                live = split_join(live, taken, keys, "left_anti", hot, order)
            else:
                live = live.join(taken, keys, "left_anti")
        live = cut_lineage(live, "dedup-live")
        left = live.count()
    if not accepted:
        return live.select(*order)
    return reduce(DataFrame.unionByName, accepted)
