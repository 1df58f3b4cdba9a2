"""Runs of repeated words against brute force."""

import hashlib
import random
import zlib

import pytest

from reviewmill.llm import periodic_runs
from reviewmill.llm.queries import QUERIES


def runs_by_hand(words, least):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stop = j + q
            if j > i and stop - i >= max(least, 2 * q) and not any(words[i : stop - p] == words[i + p : stop] for p in range(1, q)):
                found.add((i, stop - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randrange(70)
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 2)
            for i in range(a, min(n, a + rng.randrange(1, 5 * p + 1))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(500):
        words = random_words(rng)
        assert periodic_runs.runs_of(words) == runs_by_hand(words, 2)
        assert periodic_runs.find_runs(words) == runs_by_hand(words, 12)
        assert periodic_runs.find_runs(words, periodic_runs.Limits(8)) == runs_by_hand(words, 8)


def test_last_ends_are_those_of_the_longest_suffix_before():
    rng = random.Random(7)
    for _ in range(100):
        words, known = random_words(rng), periodic_runs.LastEnds(100)
        for i, word in enumerate(words):
            squares = known.append(word)
            last = {n: max((e for e in range(n - 1, i) if words[e - n + 1 : e + 1] == words[i - n + 1 : i + 1]), default=-1) for n in range(1, i + 2)}
            longest = [n for n in range(1, i + 1) if last[n] >= 0 and last[n + 1] != last[n]]
            want = {(i - last[n], n) for n in longest if i - last[n] <= n}
            assert set(squares) == want


def test_stretches_hold_every_run():
    words = list(range(50)) + [1, 2, 3, 4, 5, 6] * 2 + list(range(100, 150)) + [7] * 12 + [8] * 11
    assert periodic_runs.find_runs(words) == [(50, 12, 6), (112, 12, 1)]
    with pytest.raises(ValueError):
        periodic_runs.Limits(7)


ROWS = [
    (1, "a b c " * 5, "x"),
    (1, "a b c " * 5, "x"),
    (2, None, None),
    (3, " \t\n", "y"),
    (4, "one two\x0bthree", None),
    (None, "z " * 20, "y"),
    (5, "w " * 300_000, "long"),
    (6, " ".join(f"w{i % 70_000}" for i in range(300_000)), "long"),
    (7, "é ü é ü é ü é ü é ü é ü and the end", ""),
]


def test_table_of_odd_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, runs string").repartition(3)
    got = periodic_runs.detect(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = sorted(got.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    runs = {1: [(0, 15, 3)], None: [(0, 20, 1)], 5: [(0, 300_000, 1)], 6: [(0, 300_000, 70_000)], 7: [(0, 12, 2)]}
    rest = {1: "a b c", None: "z", 5: "w", 7: "é ü and the end", 6: " ".join(f"w{i}" for i in range(70_000))}
    for r, (key, text, _) in zip(found, want, strict=True):
        assert r["n_words"] == len((text or "").encode().split())
        assert [tuple(x) for x in r["runs"]] == runs.get(key, [])
        assert r["collapsed"] == rest.get(key, " ".join(x.decode() for x in (text or "").encode().split()))


def test_table_of_nothing(spark):
    assert periodic_runs.detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "a b"), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in rows:
        words, n = (text or "").split(), len((text or "").split())
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_hand(words, 12)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((key, len(runs), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (said, kept))))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 5
