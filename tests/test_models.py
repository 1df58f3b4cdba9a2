import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import cellindex
from reviewmill.operators import embedding as E
from reviewmill.operators import language as L
from reviewmill.operators import search as Q
from reviewmill.operators import sentiment as S
from reviewmill.plans import scoring, searching, training
from reviewmill.session import scratch_path
from reviewmill.sources import registry

GOOD, BAD, FLAT = "great lovely perfect fast", "broken slow awful crash", "okay average normal plain"
TEXTS = [
    (f"{a} {b} screen {i}", label)
    for label, words in (("positive", GOOD), ("negative", BAD), ("neutral", FLAT))
    for i, a in enumerate(words.split())
    for b in words.split()
]


# Irregular texts: their singular values are distinct, so truncation is well defined.
WORDS = [f"word{i}" for i in range(30)]
CORPUS = [" ".join(random.Random(i).choices(WORDS, k=4 + i % 9)) for i in range(40)]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(TEXTS, "text string, label string")


@pytest.fixture(scope="module")
def model(examples):
    return S.fit_sentiment(examples)


def dense_tfidf(texts):
    def terms(text):
        words = re.findall(r"\b\w\w+\b", text.lower())
        return words + [" ".join(pair) for pair in zip(words, words[1:], strict=False)]

    counted = [collections.Counter(terms(t)) for t in texts]
    known = sorted({term for c in counted for term in c})
    df = collections.Counter(term for c in counted for term in c)
    a = np.array([[(1 + math.log(c[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) if t in c else 0 for t in known] for c in counted])
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def test_sentiment_learns_scores_and_evaluates(spark, examples, model):
    scored = S.predict_sentiment(examples.withColumnRenamed("label", "truth"), model)
    result = S.evaluate(scored)
    summary = result.summary.first()
    assert (summary.accuracy, summary.macro_f1, summary.sample_count) == (1.0, 1.0, len(TEXTS))
    assert all(1 / 3 < r.score < 1 for r in scored.select("score").collect())
    assert S.predict_sentiment(examples.limit(0), model).count() == 0


def test_sliced_tables_agree(spark, examples, model):
    def scores(m, **options):
        rows = S.predict_sentiment(examples, m, **options).select("text", "label", "score").collect()
        return {(r.text, r.label): r.score for r in rows}

    a, c = scores(model), scores(model, limit=800)
    assert model.table().slices(800) > 1
    assert a.keys() == c.keys()
    assert max(abs(a[k] - c[k]) for k in a) < 1e-9


def test_a_bounded_sample_has_every_label_and_every_term_its_own_weights(spark, examples):
    few = S.fit_sentiment(examples, training_rows=30)
    assert few.labels == ["negative", "neutral", "positive"]
    scored = S.predict_sentiment(examples.withColumnRenamed("label", "truth"), few)
    assert S.evaluate(scored).summary.first().macro_f1 > 0.9
    sampled = few.terms.count()
    assert sampled == few.term_count == few.terms.select("hash").distinct().count()
    many = spark.createDataFrame([(f"only{i} here{i}", f"label{i % 40}") for i in range(120)], "text string, label string")
    assert len(S.fit_sentiment(many, max_iterations=5).labels) == 40


def test_empty_inputs_are_errors(spark, examples):
    with pytest.raises(ValueError):
        S.fit_sentiment(examples.limit(0))
    with pytest.raises(ValueError):
        S.evaluate(examples.limit(0).withColumn("truth", F.col("label")))
    with pytest.raises(ValueError):
        E.fit_embedding(examples.limit(0))


def test_metrics_by_hand(spark):
    pairs = [("negative", "negative")] * 3 + [("negative", "neutral")] + [("positive", "negative")] * 2 + [("positive", "positive")] * 2
    result = S.evaluate(spark.createDataFrame(pairs, "truth string, label string"))
    matrix = {r.truth: (r.negative, r.neutral, r.positive) for r in result.matrix.collect()}
    assert matrix == {"negative": (3, 1, 0), "neutral": (0, 0, 0), "positive": (2, 0, 2)}
    f1 = {r.label: round(r.f1, 6) for r in result.per_label.collect()}
    assert f1 == {"negative": round(2 * 0.6 * 0.75 / 1.35, 6), "neutral": 0.0, "positive": round(2 * 0.5 / 1.5, 6)}


def test_published_models_come_back(spark, examples, tmp_path):
    with pytest.raises(training.QualityGate):
        training.publish_sentiment(spark, str(tmp_path), "bad", examples, examples, gate=1.1)
    fitted, _ = training.publish_sentiment(spark, str(tmp_path), "v1", examples, examples)
    loaded = registry.load_sentiment_model(spark, str(tmp_path), "v1")
    key = lambda m: sorted((r.text, r.label, r.score) for r in S.predict_sentiment(examples.select("text"), m).collect())
    assert key(fitted) == key(loaded)
    assert registry.load_report(spark, str(tmp_path), "v1")["confusion_matrix"] == [[16, 0, 0], [0, 16, 0], [0, 0, 16]]


@pytest.mark.parametrize("dimensions", [8, 100])
def test_embeddings_equal_a_dense_decomposition(spark, dimensions, tmp_path):
    texts = CORPUS
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    model = training.publish_embedding(spark, str(tmp_path), "v1", corpus, dimensions)
    a = dense_tfidf(texts)
    width = max(1, min(dimensions, a.shape[1] - 1, len(texts) - 1))
    assert (model.effective_dimensions, model.corpus_size) == (width, len(texts))
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    projected = a @ vt[:width].T
    projected /= np.linalg.norm(projected, axis=1, keepdims=True)
    loaded = registry.load_embedding_model(spark, str(tmp_path), "v1")
    for m, options in ((model, {}), (loaded, {"limit": 6000})):
        rows = E.embed(corpus, m, **options).collect()
        order = {r.text: r.embedding for r in rows}
        got = np.array([order[t] for t in texts])
        assert got.shape == (len(texts), dimensions)
        assert np.abs(got @ got.T - projected @ projected.T).max() < 1e-4
    assert E.embed(spark.createDataFrame([("zzz",)], "text string"), model).first().embedding == [0.0] * dimensions


def test_fit_by_joins_equals_fit_by_passes(spark):
    texts = CORPUS[:16]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    small = E.fit_embedding(corpus, dimensions=len(texts))
    joined = E.fit_embedding(corpus, dimensions=len(texts), limit=10, rows_per_task=3)
    assert joined.basis.shape[0] == 0 and joined.dense_count == joined.term_count

    def gram(m):
        order = {r.text: r.embedding for r in E.embed(corpus, m).collect()}
        x = np.array([order[t] for t in texts])
        return x @ x.T

    assert np.abs(gram(small) - gram(joined)).max() < 1e-3


def test_language_profiles_learn_and_declared_wins(spark):
    rows = [
        ("rain fell on the quiet harbour while two fishermen mended their nets", "en"),
        ("grey clouds hung above the old stone bridge beside the market hall", "en"),
        ("der alte mann sitzt am ufer und wirft den enten brotkrumen zu", "de"),
        ("übermorgen fahren wir mit dem nachtzug durch das verschneite tal", "de"),
    ]
    model = L.fit_language_model(L.language_profiles(spark.createDataFrame(rows, "text string, language string")))
    asked = [("the fishermen hung their nets above the bridge", None), ("der nachtzug fährt durch das tal", None), ("ok", None), ("12345", None), ("the market", "fr")]
    df = spark.createDataFrame(asked, "text string, language string")
    got = {r.text: r.language for r in L.resolve_language(df, model, "text").collect()}
    assert list(got[t] for t, _ in asked) == ["en", "de", "und", "und", "fr"]
    sliced = L.detect_language(df, model, "text", "found", limit=300)
    assert model.table.slices(300) > 1
    found = {r.text: r.found for r in sliced.collect()}
    assert [found[t] for t, _ in asked[:4]] == ["en", "de", "und", "und"]


def rare_letters(df):
    """How often a text has each of three letters."""
    return df.withColumn("embedding", F.array(*[F.regexp_count("text_normalized", F.lit(c)).cast("float") for c in "zqk"]))


def test_embed_pending_and_search(spark):
    texts = ["zigzag puzzle", "quart quote", "kayak", "mellow tune"]
    reviews = spark.createDataFrame(
        [(f"r{i}", "o", "p" if i < 4 else "q", t, t, "en", 5, "pending") for i, t in enumerate(texts + ["a lazy lizard elsewhere"])],
        "id string, organization_id string, product_id string, text_normalized string, text_redacted string, language string, rating short, status string",
    ).withColumn("occurred_at", F.timestamp_seconds(F.lit(0))).withColumn("created_at", F.col("occurred_at"))
    empty = spark.createDataFrame([], "id string, organization_id string, product_id string, review_id string, model_name string, model_version string, embedding array<float>, created_at timestamp")
    at = F.timestamp_seconds(F.lit(1))
    run = scoring.embed_pending(reviews, empty, rare_letters, "v1", at, organization_id="o", product_id="p")
    assert run.embedded == 4
    assert scoring.embed_pending(reviews, run.embeddings, rare_letters, "v1", at, product_id="p").embedded == 0
    assert scoring.embed_pending(reviews, run.embeddings, rare_letters, "v2", at, product_id="p").embedded == 4
    found = searching.semantic_search(run.embeddings, reviews, rare_letters, "a maze", "v1", "o", "p").collect()
    assert [(r.review_id, r.similarity) for r in found] == [("r0", 1.0), ("r1", 0.0), ("r2", 0.0), ("r3", 0.0)]
    assert searching.semantic_search(empty, reviews, rare_letters, "a maze", "v1", "o", "p").collect() == []
    orphaned = reviews.where("id <> 'r0'")
    best = Q.search_similar(run.embeddings, orphaned, [1.0, 0.0, 0.0], 2, model_version="v1")
    assert [r.review_id for r in best.collect()] == ["r1", "r2"]


def by_length(df):
    """Short texts are negative, texts with digits neutral, all others positive."""
    label = F.when(F.length("text_normalized") < 5, "negative").when(F.col("text_normalized").rlike("[0-9]"), "neutral")
    return df.withColumn("label", label.otherwise("positive")).withColumn("score", F.lit(0.75))


def test_analyze_pending_is_idempotent_and_versioned(spark):
    reviews = spark.createDataFrame(
        [("a", "o", "p", "a long remark", "pending"), ("b", "o", "p", "meh", "pending"), ("c", "o", "q", "room 12 again", "pending")],
        "id string, organization_id string, product_id string, text_normalized string, status string",
    ).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    none = spark.createDataFrame([], "id string, organization_id string, product_id string, review_id string, model_name string, model_version string, label string, score double, created_at timestamp")
    at = F.timestamp_seconds(F.lit(1))
    first = scoring.analyze_pending(reviews, none, by_length, "v1", at, limit=500, product_id="p")
    assert {r.label: r["count"] for r in first.counts.collect()} == {"positive": 1, "negative": 1}
    assert {r.id: r.status for r in first.reviews.collect()} == {"a": "ready", "b": "ready", "c": "pending"}
    assert scoring.analyze_pending(reviews, first.sentiments, by_length, "v1", at, product_id="p").analyzed == 0
    second = scoring.analyze_pending(reviews, first.sentiments, by_length, "v2", at, product_id="p")
    assert (second.analyzed, second.sentiments.count()) == (2, 4)


def test_search_many_and_ann(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((10, 16))
    points = np.repeat(centers, 30, axis=0) + 0.05 * rng.standard_normal((300, 16))
    points[5] = points[6]
    rows = [(i, "v1", [float(x) for x in p]) for i, p in enumerate(points)]
    stored = spark.createDataFrame(rows, "review_id long, model_version string, embedding array<float>").repartition(5)
    queries = stored.where("review_id % 7 = 0 or review_id = 5").select(F.col("review_id").alias("query_id"), "embedding")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for per_pass in (1000, 10):
        got = collections.defaultdict(list)
        for r in Q.search_many(stored, queries, 4, queries_per_pass=per_pass).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.review_id)
        assert len(got) == 44
        assert got[5][:2] == [5, 6]
        for q, found in got.items():
            sims = unit @ unit[q]
            assert min(sims[found]) >= np.sort(sims)[-4] - 1e-6
    index = cellindex.build_index(stored, scratch_path(spark, "cells"))
    query = [float(x) for x in points[0]]
    exact = {r.review_id for r in Q.nearest(stored, query, 10).collect()}
    close = [(r.review_id, r.similarity) for r in cellindex.ann_search(spark, index, query, 10).collect()]
    assert len(exact & {i for i, _ in close}) >= 8
    assert [s for _, s in close] == sorted((s for _, s in close), reverse=True)
    assert cellindex.ann_search(spark, index, query, 300).count() == 300
    assert cellindex.ann_search(spark, index, query, 300, model_version="v2").count() == 0
    # ten groups of thirty: a search reads its own group's folders, not the others
    assert index.probes(cellindex.RECALL) <= len(index.centres) // 4
    again = cellindex.load_index(spark, index.path)
    assert np.allclose(again.centres, index.centres) and np.allclose(again.reach, index.reach)


def test_cells_find_far_neighbours_and_read_fewer_files(spark):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((1500, 64))
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)] + [(2000, None), (2001, [0.0] * 64)]
    stored = spark.createDataFrame(rows, "review_id long, embedding array<double>").repartition(4)
    index = cellindex.build_index(stored, scratch_path(spark, "cells"))
    assert index.vectors(spark).count() == 1501
    asked = stored.where("review_id % 50 = 0 and review_id < 1500").select(F.col("review_id").alias("query_id"), "embedding")
    got = collections.defaultdict(list)
    for r in cellindex.ann_search_many(spark, index, asked, 10, query_bytes=8 * 64 * 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.review_id)
    exact = {(r.query_id, r.review_id) for r in Q.search_many(stored, asked, 10).collect()}
    found = {(q, r) for q, ids in got.items() for r in ids}
    assert len(exact) == len(found) == 300 and len(exact & found) >= 270
    one = cellindex.ann_search(spark, index, [float(v) for v in points[50]], 10, recall=0.5)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString()
    read = index.vectors(spark).where(F.col("cell").isin(index.ranked(points[50:51])[0, : index.probes(0.5)].tolist()))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(read) < files(index.vectors(spark)) / 2
    assert {r.review_id for r in one.collect()} <= {r.review_id for r in read.collect()}


def test_index_of_little(spark):
    none = spark.createDataFrame([], "review_id long, embedding array<float>")
    index = cellindex.build_index(none, scratch_path(spark, "cells"))
    asked = spark.createDataFrame([(1, [1.0]), (2, None)], "query_id long, embedding array<double>")
    assert cellindex.ann_search_many(spark, index, asked, 10).collect() == []
    one = spark.createDataFrame([(7, [0.0, 2.0])], "review_id long, embedding array<double>")
    index = cellindex.build_index(one, scratch_path(spark, "cells"))
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    assert [tuple(r) for r in cellindex.ann_search_many(spark, index, asked, 10).collect()] == [(1, 7, 1.0, 1)]
    with pytest.raises(ValueError):
        cellindex.build_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "review_id long, embedding array<double>"), scratch_path(spark, "cells"))


def test_corpus_statistics_are_those_of_all_labelled_rows(spark, examples):
    few = S.fit_sentiment(examples, training_rows=9)
    every = S.fit_sentiment(examples)
    known = lambda m: {r["hash"]: round(r.weight, 9) for r in m.terms.collect()}
    assert known(few) == known(every) and few.term_count == every.term_count
    assert few.terms.where(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x)) == 0).count() > 0
