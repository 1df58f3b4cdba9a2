import random

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import dedup as D
from reviewmill.operators.joins import hot_keys, split_join
from reviewmill.operators.keyindex import KeyIndex, StoredKeys
from reviewmill.session import scratch_path

SCHEMA = "path string, row_number long, organization_id string, content_hash string, source_id string, external_id string"


def in_sequence(rows, stored=()):
    """Row by row, as a loop: the numbers of the accepted rows."""
    hashes = {(o, h) for o, h, _, _ in stored}
    externals = {(s, e) for _, _, s, e in stored if e is not None}
    kept = []
    for i, (o, h, s, e) in enumerate(rows):
        if (o, h) not in hashes and (e is None or (s, e) not in externals):
            hashes.add((o, h))
            externals |= {(s, e)} if e is not None else set()
            kept.append(i)
    return kept


def random_rows(seed, n, hot=0.0):
    rng = random.Random(seed)
    k = max(2, n // 3)
    return [
        (f"o{rng.randint(0, 1)}", f"h{0 if rng.random() < hot else rng.randint(0, k)}", f"s{rng.randint(0, 1)}",
         None if rng.random() < 0.2 else f"e{0 if rng.random() < hot / 2 else rng.randint(0, k)}")
        for _ in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)


CHAIN = [pair for j in range(30) for pair in (("o", f"h{j}", "s", f"e{j}"), ("o", f"h{j + 1}", "s", f"e{j}"))]


@pytest.mark.parametrize(
    ("rows", "options"),
    [
        ([("o", "h1", "s", "e1"), ("o", "h2", "s", "e1"), ("o", "h2", "s", "e2")], {}),
        (random_rows(1, 200, 0.4), {"rows_per_task": 20, "broadcast_bytes": 0}),
        (random_rows(2, 300), {"parallel_rounds": 1}),
        (CHAIN, {"parallel_rounds": 2}),
        (CHAIN[:12], {"parallel_rounds": 1}),
    ],
)
def test_dual_key_dedup_equals_the_loop(spark, rows, options):
    got = sorted(r.row_number for r in D.ordered_dual_key_dedup(frame(spark, rows), **options).collect())
    assert got == in_sequence(rows)


@pytest.mark.parametrize("options", [{}, {"parallel_rounds": 1}, {"parallel_rounds": 0}])
def test_dual_key_dedup_without_a_tenant(spark, options):
    rows = [(None, "h1", "s", None), (None, "h1", "s", None), (None, "h2", "s", "e1"), ("o", "h1", "s", "e1"), ("o", None, "s", None), (None, "h3", None, "e1")]
    got = sorted(r.row_number for r in D.ordered_dual_key_dedup(frame(spark, rows), **options).collect())
    assert got == [0, 2, 4, 5]


def test_plans_have_no_single_partition(spark):
    rows = frame(spark, random_rows(3, 60))
    for df in (D.dedup_against_existing(rows, rows.limit(0)), D.dedup_external_id(rows, rows), D.ordered_dual_key_dedup(rows, rows)):
        assert "SinglePartition" not in df._jdf.queryExecution().toString()


def test_dual_key_dedup_against_stored(spark):
    rows = random_rows(5, 150, 0.3)
    stored = [("o0", "h1", "s0", "e2"), ("o1", "h2", "s1", None), ("o0", "h0", "s1", "e0")]
    for options in ({}, {"rows_per_task": 10, "broadcast_bytes": 0}):
        got = D.ordered_dual_key_dedup(frame(spark, rows), frame(spark, stored), **options)
        assert sorted(r.row_number for r in got.collect()) == in_sequence(rows, stored)


def test_single_key_dedup(spark):
    rows = frame(spark, [("o", "h1", "s", None), ("o", "h1", "s", None), ("p", "h1", "s", "e"), ("o", "h2", "s", "e")])
    assert sorted(r.row_number for r in D.dedup_in_batch(rows).collect()) == [0, 2, 3]
    assert sorted(r.row_number for r in D.dedup_external_id(rows).collect()) == [0, 1, 2]
    stored = frame(spark, [("o", "h1", "s", "e")])
    assert sorted(r.row_number for r in D.dedup_against_existing(rows, stored).collect()) == [2, 3]
    assert sorted(r.row_number for r in D.already_stored(rows, stored).collect()) == [0, 1]
    assert sorted(r.row_number for r in D.dedup_external_id(rows, stored).collect()) == [0, 1]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_a_plain_join(spark, how):
    left = spark.createDataFrame([(i, None if i % 5 == 0 else ("a" if i % 3 else f"k{i % 11}")) for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("k0", 2), ("k4", 3)], "k string, v int")
    hot = hot_keys(left.where("k is not null"), ["k"], 25)
    assert [r.k for r in hot.collect()] == ["a"]
    got = split_join(left, right, ["k"], how, hot, ["i"])
    key = lambda r: str(tuple(r))
    assert sorted(got.select("i", "k").collect(), key=key) == sorted(left.join(right, "k", how).select("i", "k").collect(), key=key)


def test_dual_key_dedup_of_a_long_chain(spark):
    """Each row shares its hash with the row before and its external id with the row after."""
    n = 100_000
    i = F.col("id")
    rows = spark.range(n).select(
        F.lit("p").alias("path"), i.alias("row_number"), F.lit("o").alias("organization_id"), F.concat(F.lit("h"), F.floor((i + 1) / 2).cast("string")).alias("content_hash"),
        F.lit("s").alias("source_id"), F.concat(F.lit("e"), F.floor(i / 2).cast("string")).alias("external_id"),
    )
    got = D.ordered_dual_key_dedup(rows, parallel_rounds=1).select("row_number")
    assert got.count() == n // 2 and got.where("row_number % 2 = 1").isEmpty()


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_pointers_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(("o", f"h{rng.randint(i // 3, i // 3 + 4)}", "s", None if rng.random() < 0.1 else f"e{rng.randint(i // 3, i // 3 + 3)}")) for i in range(150)]
    got = sorted(r.row_number for r in D.ordered_dual_key_dedup(frame(spark, rows), parallel_rounds=0).collect())
    assert got == in_sequence(rows)


def both_indexes(spark, buckets=4):
    root = scratch_path(spark, "keys")
    return StoredKeys(tuple(KeyIndex.open(spark, f"{root}/{i}", keys, buckets) for i, keys in enumerate((D.HASH_KEYS, D.EXTERNAL_KEYS))))


def test_key_index_equals_a_stored_table(spark):
    rows, stored = frame(spark, random_rows(5, 150, 0.3)), frame(spark, random_rows(6, 80, 0.3))
    index = both_indexes(spark)
    numbers = lambda df: sorted(r.row_number for r in df.collect())
    assert numbers(D.ordered_dual_key_dedup(rows, index)) == numbers(D.ordered_dual_key_dedup(rows))
    index.add(stored.where("row_number < 50"), 0)
    index.add(stored.where("row_number >= 30"), 1)
    for check in (D.already_stored, D.dedup_against_existing, D.dedup_external_id, D.ordered_dual_key_dedup):
        assert numbers(check(rows, index)) == numbers(check(rows, stored))
    # a batch that is replayed sees the batches before it only
    assert numbers(D.already_stored(rows, index.until(1))) == numbers(D.already_stored(rows, stored.where("row_number < 50")))
    index.add(stored.where("row_number >= 30"), 1)
    assert numbers(D.already_stored(rows, index)) == numbers(D.already_stored(rows, stored))


def test_stored_keys_stay_in_their_buckets(spark):
    index = both_indexes(spark).of(D.HASH_KEYS)
    index.add(frame(spark, random_rows(7, 200)), 0)
    plan = index.known(frame(spark, random_rows(8, 50)))._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("LeftSemi") :].split("FileScan parquet")
    assert len(stored_side) == 2 and "Bucketed: true" in stored_side[1]
    # from the join down to the scan of the stored keys there is no exchange
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*("))
    lines = plan[plan.index("LeftSemi") :].splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    above = [lines[scan]]
    for line in reversed(lines[1:scan]):
        if depth(line) < depth(above[-1]):
            above.append(line)
    assert not any("Exchange" in line for line in above)


def test_index_is_found_again_by_its_path(spark):
    path = scratch_path(spark, "keys")
    rows = frame(spark, random_rows(9, 40))
    KeyIndex.open(spark, path, D.HASH_KEYS, 4).add(rows, 3)
    found = KeyIndex.open(spark.newSession(), path, D.HASH_KEYS, 4)
    assert found.stored().count() == rows.select(*D.HASH_KEYS).distinct().count()


def test_rows_are_made_once_to_meet_stored_keys(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    rows = spark.range(50).select(F.col("id").alias("row_number"), F.lit("o").alias("organization_id"), F.udf(count, "string")((F.col("id") % 7).cast("string")).alias("content_hash"))
    stored = spark.createDataFrame([("o", "3"), ("o", "5")], "organization_id string, content_hash string")
    kept = D.dedup_against_existing(rows, stored, order=("row_number",)).count()
    assert (kept, made.value) == (36, 50)
