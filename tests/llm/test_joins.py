"""N-gram join, mixing, both vector searches and the pipeline against brute force."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewmill.llm import cover_tree, mixing, ngram_join, stable_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_by_hand(text, n):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components_by_hand(rows, n=5, percent=75):
    """(n_shingles, component) per row number."""
    sets = [sets_by_hand(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            group[root(j)] = root(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = root(i)
            least[r] = min(least.get(r, key), key)
    return [(key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)]


def near_copies(rng, groups=12):
    """Copies, near copies on both sides of the threshold, shared passages, short and odd texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts = [None, "", "  \t", "one", "ONE", "one two", "one two three four five", "One two three four five", "one\x0btwo three\u00a0four five six"]
    for g in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(6, 120))))
        for _ in range(int(rng.integers(1, 14))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 20))):
                own[int(rng.integers(len(own)))] = f"e{rng.integers(10**6)}"
            text = " ".join(own)
            texts.append(text if g % 3 else text + " " + passage)
    texts += [passage, passage, passage.upper(), " ".join(rng.choice(vocabulary, 3000))]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_TASK", 40)
    rng = np.random.default_rng(seed)
    texts = near_copies(rng)
    ids = rng.permutation(len(texts) * 3)[: len(texts)].tolist()
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[-1]), (None, None), (ids[10], texts[10]), (ids[-1], texts[-2])]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n int, h1 string").repartition(5)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs).collect())
    want = components_by_hand(rows)
    # a document without words is its own component
    assert got == collections.Counter((k, n, k if n == 0 else c) for k, n, c in want)


def test_large_group_of_near_copies_needs_no_pairs(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.choice(150, 1 if i % 4 else 7, replace=False):
            own[at] = f"e{i}x{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()}
    assert got == {k: c for k, _, c in components_by_hand(rows)}


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.similar_documents(empty).count() == 0
    assert ngram_join.first_of_groups(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 250), (250, 300)]
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and all(got[200 + i] == 100 for i in range(30)) and got[300] == 250


def test_first_of_groups_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (9, "other words entirely here now"), (4, None), (6, ""), (None, text), (9, "another text of the same id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = collections.Counter((r["doc_id"], r["text"]) for r in ngram_join.first_of_groups(docs).collect())
    assert kept == collections.Counter([(3, text + " more"), (9, "other words entirely here now"), (9, "another text of the same id"), (4, None), (6, ""), (None, text)])


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 3, 300) == pytest.approx([187.5, 75, 37.5])
    targets = mixing.water_fill([10, 1000, 0], [5, 2, 1], 3, 1010)
    assert targets == pytest.approx([30, 980, 0])
    assert mixing.water_fill([], [], 3, 0) == []


def flow_cost(patterns, quotas, given):
    return sum(max(0, g - k * n) for g, (_, n) in zip(given, patterns, strict=True) for k in range(1, 3))


def test_route_is_cheapest():
    cases = [
        ([({"a"}, 4), ({"b"}, 3), ({"a", "b"}, 5)], {"a": 9, "b": 6}),
        ([({"a", "b"}, 4), ({"b"}, 2), ({"c"}, 1)], {"a": 6, "b": 5, "c": 3}),
        ([({"a", "b"}, 2), ({"b", "c"}, 2), ({"c"}, 2)], {"a": 4, "b": 1, "c": 5}),
    ]
    for patterns, quotas in cases:
        patterns = [(frozenset(m), n) for m, n in patterns]
        given = mixing.route(patterns, quotas, 3)
        ranges = [range(3 * n + 1) for _, n in patterns]

        def feasible(x, patterns=patterns, quotas=quotas):
            # every set of patterns fits the quotas of its sources (Hall)
            for r in range(1, len(x) + 1):
                for own in itertools.combinations(range(len(x)), r):
                    names = set().union(*(patterns[i][0] for i in own))
                    if sum(x[i] for i in own) > sum(quotas[s] for s in names):
                        return False
            return True

        every = [x for x in itertools.product(*ranges) if feasible(x)]
        most = max(map(sum, every))
        assert sum(given) == most and feasible(given)
        assert flow_cost(patterns, quotas, given) == min(flow_cost(patterns, quotas, x) for x in every if sum(x) == most)


def test_mix_meets_targets_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        source = None if i % 50 == 0 else ["big", "mid", "tiny"][0 if i % 3 else 1 if i % 7 else 2]
        rows.append((i, int(rng.integers(0, 200)), source, "clash", 1))
    rows += [(None, 50, "mid", "clash", 1), (7, 0, "mid", None, None), (7, 0, "mid", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string, target string, extra int")
    used, targets = mixing.mix_by_source(docs, "source", (5, 2, 1))
    got = used.collect()
    want = {r["_source"]: (r["source_size"], r["target"]) for r in targets.collect()}
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["rounds"] * r["size"]
        taken[r["source"]] += r["taken"]
    total = sum(r[1] for r in rows)
    assert sum(t for _, t in want.values()) == pytest.approx(total)
    for source, (size, target) in want.items():
        assert size == sum(r[1] for r in rows if r[2] == source) and target <= 3 * size + 1e-6
        assert abs(taken[source] - target) <= 200
    order = sorted(want, key=lambda s: (s is None, s or ""))
    assert order == ["big", "mid", "tiny", None]
    again, _ = mixing.mix_by_source(docs.repartition(7), "source", (5, 2, 1))
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, got))


def test_mix_of_overlapping_sources(spark):
    rows = [(i, 10, [["a"], ["b"], ["b", "a"], [], None][i % 5]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, held array<string>")
    got = mixing.mix(docs, "held", {"a": 1.0, "b": 3.0}).collect()
    by = collections.Counter()
    for r in got:
        by[tuple(sorted(r["held"] or ()))] += r["taken"]
    assert by[()] == 0 and sum(by.values()) == pytest.approx(5000, abs=40)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, size long, source string")
    used, targets = mixing.mix_by_source(docs, "source", (5, 2, 1))
    assert used.count() == 0 and targets.count() == 0
    zero = spark.createDataFrame([(1, 0, "a"), (2, 0, None)], "doc_id long, size long, source string")
    assert [r["taken"] for r in mixing.mix_by_source(zero, "source", (5, 2, 1))[0].collect()] == [0, 0]


VECTORS = "vec_id long, embedding array<float>, label int, score double, cell long"


def odd_vectors(rng, n=400, width=8):
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[50:120] = x[50]  # many copies of one vector
    x[120:200] = (x[120] + rng.normal(size=(80, width)) * 0.01).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [None, [], [None] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [1.0, 2.0], [1.0] * (width - 1) + [None]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(1100, [0.0] * width), (1150, [-0.0] * width), (None, rows[3][1]), (100, rows[100][1]), (300, rows[7][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in rows], VECTORS).repartition(3)


def hits_by_hand(rows, value, score, every, k, zero):
    kept = collections.defaultdict(list)
    for i, v in rows:
        if i is None or v is None or len(v) != 8 or any(c is None or not np.isfinite(c) for c in v):
            continue
        if not zero and not any(v):
            continue
        kept[i].append(value(np.array(v, np.float64)))
    out = {}
    for q in kept:
        if q % every == 0:
            best = {i: max(score(a, b) for a in kept[q] for b in kept[i]) for i in kept if i != q}
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def collected(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 64)
    monkeypatch.setattr(cover_tree, "QUERIES_PER_TASK", 3)
    rows = odd_vectors(np.random.default_rng(6))
    whole = F.transform("x", lambda c: F.floor(c * F.lit(1024.0)).cast("long"))
    got = collected(cover_tree.top_products(frame(spark, rows), "vec_id", "embedding", whole, F.col("vec_id") % 10 == 0, 10))
    want = hits_by_hand(rows, lambda v: np.floor(1024 * v).astype(np.int64), lambda a, b: int(a @ b), 10, 10, True)
    assert got == want


def test_products_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i * 2**20), -float(i), 3.0]) for i in range(30)]
    whole = F.transform("x", lambda c: F.floor(c * F.lit(1.0)).cast("long"))
    got = collected(cover_tree.top_products(frame(spark, rows), "vec_id", "embedding", whole, F.col("vec_id") == 0, 3))
    assert [i for i, _ in got[0]] == [1, 2, 3] or [i for i, _ in got[0]] == [27, 28, 29] or len(got[0]) == 3
    assert all(s == (1 << 63) - 1 for _, s in got[0])


def test_cover_tree_covers():
    points = np.random.default_rng(8).normal(size=(500, 3))
    tree = cover_tree.CoverTree(points)
    seen = []
    for node in range(len(tree.centre)):
        below = cover_tree._rows_below(tree, node)
        away = np.sqrt(((points[below] - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-9
        if tree.rows[node] is not None:
            seen += tree.rows[node].tolist()
    assert sorted(seen) == list(range(500))


def test_nearest_reaches_recall_and_orders(spark, monkeypatch):
    monkeypatch.setattr(stable_search, "CELL_ROWS", 64)
    monkeypatch.setattr(stable_search, "QUERIES_PER_TASK", 3)
    rows = odd_vectors(np.random.default_rng(9))
    got = collected(stable_search.nearest(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 10 == 0, 5))
    want = hits_by_hand(rows, lambda v: v, lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 10, 5, False)
    assert got.keys() == want.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    for q in got:
        assert len(got[q]) == 5
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    # all copies of one vector tie, so the smallest ids come first
    assert [i for i, _ in got[60]] == [50, 51, 52, 53, 54]


def test_chi_square_by_sampling():
    x = (np.random.default_rng(1).normal(size=(200_000, stable_search.DIMENSIONS)) ** 2).sum(axis=1)
    for at in (3.0, 8.0, 15.0):
        assert stable_search.chi_square(at) == pytest.approx((x <= at).mean(), abs=5e-3)
    assert stable_search.chi_square(stable_search.radius_factor(0.9) ** 2) == pytest.approx(0.9)


@pytest.mark.parametrize("rows", [[], [(3, [1.0, 2.0])], [(0, [1.0, 2.0])], [(0, None), (50, [None])], [(0, [1.0]), (1, [2.0])]])
def test_searches_of_little(spark, rows):
    table = frame(spark, rows)
    near = stable_search.nearest(table, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    best = cover_tree.top_products(table, "vec_id", "embedding", F.transform("x", lambda c: F.floor(c).cast("long")), F.col("vec_id") % 50 == 0, 5).collect()
    want = [(0, 1)] if len(rows) == 2 and rows[0][1] else []
    assert [(r["query_id"], r["vec_id"]) for r in near] == want
    assert [(r["query_id"], r["vec_id"]) for r in best] == want


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(300):
        toxic = i % 5 == 0
        own = list(rng.choice(vocabulary, 40)) + (["vile", "filth"] if toxic else [])
        rows.append((i, " ".join(rng.permutation(own)), "en", f"s{i % 3}", 1, "extra"))
        marks.append((i, int(toxic), 1))
    rows.append((900, rows[1][1] + " added", "en", "s1", 1, "extra"))
    rows.append((901, "password=abc123def456 " + " ".join(rng.choice(vocabulary, 30)), "en", "s2", 1, "extra"))
    rows.append((902, None, None, None, None, None))
    spark.createDataFrame(rows, DOCS + ", _extra string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(docs.collect())
    toxic_left, once, masked, mixed = seen
    kept = {r["doc_id"] for r in toxic_left}
    assert len(kept & {i for i in range(0, 300, 5)}) <= 3 and len({i for i in range(300) if i % 5} - kept) <= 3
    assert 900 not in {r["doc_id"] for r in once} and {902, 901} <= {r["doc_id"] for r in once}
    assert len(masked) == len(once) and "abc123def456" not in "".join(r["text"] or "" for r in masked)
    copies = collections.Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in masked}
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] // r["t"] for r in packed} == dict(copies)
