"""Hard negatives against brute force, the Hilbert curve and the bounds of its blocks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, w int"


def mined_by_hand(rows, positives=5, negatives=3):
    """Rows as the operator takes them: vec_id, label, whole-number vector."""
    first = {}
    for key, label, v in rows:
        if key is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v):
            held = (label, [int(np.floor(256.0 * float(np.float32(c)))) for c in v])
            first[key] = min(first.get(key, held), held)
    out = []
    for a, (label, v) in first.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), i, k) for i, (k, u) in first.items() if i != a and len(u) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(docs):
    whole = F.transform("x", lambda c: F.floor(c * F.lit(256.0)).cast("long"))
    found = hard_negatives.mine(docs, "vec_id", "embedding", F.col("label"), whole, F.col("vec_id") % 50 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize(("seed", "grain"), [(1, 0.0), (2, 0.5), (3, 1.0)])
def test_mined_equal_brute_force(spark, monkeypatch, seed, grain):
    """Many zones and blocks; coarse vectors bring ties, copies a zone of one place."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "ZONE_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_TASK", 3)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(900, 6)) + 2 * rng.normal(size=(9, 6))[rng.integers(0, 9, 900)]
    if grain:
        v = np.round(v / grain) * grain
    v[300:600] = v[300]
    ids = rng.permutation(3000)[:900]
    rows = [(int(i), int(rng.integers(0, 3)), x.tolist()) for i, x in zip(ids, v, strict=True)]
    rows += [(i, i % 3, rng.normal(size=3).tolist()) for i in range(5000, 5120, 2)]
    rows += [rows[0], (rows[1][0], 2, rows[5][2]), (None, 1, [1.0] * 6), (4000, None, [1.0] * 6), (4050, 1, None), (4100, 1, []), (4150, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(4200, 1, [float("nan")] + [1.0] * 5), (4250, 1, [float("inf")] + [1.0] * 5), (4300, 7, [0.0] * 6), (4350, 1, [0.0] * 6), (4351, 2, [0.0] * 6)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    got = mined(docs)
    assert got == mined_by_hand(rows)
    assert any(r[0] > 4400 for r in got) and any(r[0] == 4350 for r in got)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0], "", 1), (2, 1, [1.0], "", 1)], SCHEMA)) == []  # no anchor
    assert mined(spark.createDataFrame([(50, 1, [1.0], "", 1)], SCHEMA)) == []


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_and_moves_one_step(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = hard_negatives.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_all_products():
    rng = np.random.default_rng(5)
    rows, anchors = rng.integers(-500, 500, (40, 7)), rng.integers(-500, 500, (30, 7))
    least, most = hard_negatives.interval(anchors, rows.min(axis=0, keepdims=True), rows.max(axis=0, keepdims=True))
    own = anchors @ rows.T
    assert (own >= least).all() and (own <= most).all()
    assert (hard_negatives.products(anchors, rows) == own).all()
    large = rng.integers(-(1 << 40), 1 << 40, (5, 3))
    want = [[max(-hard_negatives.TOP, min(hard_negatives.TOP, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in large] for x in large]
    assert hard_negatives.products(large, large).tolist() == want


def test_bounds_spare_blocks():
    """Rows along the curve in clusters: most blocks are never read, and the result is the same."""
    rng = np.random.default_rng(6)
    centres = rng.normal(scale=2000, size=(30, 5))
    rows = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(scale=20, size=(3000, 5))).astype(np.int64)
    keys = hard_negatives.Layout(rows.astype(float), 4).keys(rows.astype(float))
    order = np.argsort(keys, kind="stable")
    blocks = []
    for start in range(0, 3000, 100):
        held = np.sort(order[start : start + 100])
        blocks.append({"ids": held, "labels": held % 3, "rows": rows[held], "low": rows[held].min(axis=0), "high": rows[held].max(axis=0), "label_low": 0, "label_high": 2})
    ids = np.arange(0, 3000, 100)
    anchors = hard_negatives.Anchors(ids, ids % 3, rows[ids], np.full((30, 1), -hard_negatives.TOP), np.full((30, 1), hard_negatives.TOP))
    found, scores, read = hard_negatives.best_in_windows(anchors, blocks, 5, True)
    for a, i in enumerate(ids):
        want = sorted((-int(rows[i] @ rows[j]), j) for j in range(3000) if j != i and j % 3 == i % 3)[:5]
        assert list(zip((-scores[a, 0]).tolist(), found[a, 0].tolist(), strict=True)) == want
    assert read < 0.5 * 30 * 3000
