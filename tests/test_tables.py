import pytest
from pyspark.sql import functions as F

from reviewmill.operators import analytics, incremental, integrity, jobs, relational
from reviewmill.operators.incremental import upsert
from reviewmill.schemas import REVIEW_SENTIMENTS, REVIEWS
from reviewmill.sources.tables import read_table, store_results
from reviewmill.streaming.jobs import stream_import, stream_score


def test_tenancy(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, organization_id string")
    assert [r.id for r in relational.tenant_scope(df, "a").collect()] == [1]
    assert relational.tenant_scope(df, None).count() == 0
    assert sorted(r.id for r in relational.check_tenant_writes(df, "a").collect()) == [2, 3]
    with pytest.raises(relational.TenantViolation):
        relational.require_tenant(df, "a")


@pytest.mark.parametrize("small", [True, False])
def test_upsert(spark, monkeypatch, small):
    monkeypatch.setattr(incremental, "settled", lambda df: (df, small))
    schema = "review_id int, model_version string, label string, score double, model_name string"
    old = spark.createDataFrame([(1, "v1", "a", 0.1, "m"), (2, "v1", None, None, "m"), (1, "v2", "c", 0.3, "m")], schema)
    new = spark.createDataFrame([(1, "v1", None, 0.9, "n"), (3, "v1", "x", 0.8, "n")], schema)
    got = sorted(tuple(r) for r in upsert(old, new, ("label", "score")).collect())
    assert got == [(1, "v1", None, 0.9, "m"), (1, "v2", "c", 0.3, "m"), (2, "v1", None, None, "m"), (3, "v1", "x", 0.8, "n")]


def test_stored_results_change_only_the_partitions_they_meet(spark, tmp_path):
    path, at = str(tmp_path / "sentiments"), F.timestamp_seconds(F.lit(1))

    def rows(*given):
        made = spark.createDataFrame(list(given), "organization_id string, product_id string, review_id string, label string")
        return made.select("review_id", "organization_id", "product_id", "review_id", F.lit("m").alias("model_name"), F.lit("v1").alias("model_version"), "label", F.lit(0.5).alias("score"), at.alias("created_at")).toDF(*[f.split()[0] for f in REVIEW_SENTIMENTS.split(", ")])

    def files():
        return {p.parent.parent.name + "/" + p.parent.name: p.name for p in (tmp_path / "sentiments").rglob("part-*.parquet")}

    store = lambda df: store_results(spark, path, REVIEW_SENTIMENTS, df, ("label", "score"))
    store(rows(("o", "p", "a", "positive"), ("o", "q", "b", "neutral"), ("u", "p", "c", "negative")))
    before = files()
    store(rows(("o", "p", "a", "negative"), ("o", "p", "d", "neutral"), ("u", "new", "c", "neutral")))
    after = files()
    assert before["organization_id=o/product_id=q"] == after["organization_id=o/product_id=q"]
    assert before["organization_id=o/product_id=p"] != after["organization_id=o/product_id=p"]
    got = sorted((r.organization_id, r.product_id, r.review_id, r.label) for r in read_table(spark, path, REVIEW_SENTIMENTS).collect())
    # a key that is stored elsewhere is changed where it is
    assert got == [("o", "p", "a", "negative"), ("o", "p", "d", "neutral"), ("o", "q", "b", "neutral"), ("u", "p", "c", "neutral")]
    with pytest.raises(ValueError):
        store(rows((None, "p", "x", "neutral")))


def test_percentages_round_ties_to_even(spark):
    rows = [("o", "p", "v", "positive", 15), ("o", "p", "v", "negative", 1)]
    df = spark.createDataFrame(rows, "organization_id string, product_id string, model_version string, label string, count long")
    got = {r.label: (r.total, r.percentage) for r in analytics.sentiment_percentages(df).collect()}
    assert got == {"positive": (16, 93.8), "negative": (16, 6.2)}
    assert analytics.sentiment_percentages(df.limit(0)).count() == 0


def test_constraints(spark):
    df = spark.createDataFrame([("s", "e"), ("s", "e"), ("s", None), ("s", None)], "source_id string, external_id string")
    assert [tuple(r) for r in integrity.check_unique(df, ("source_id", "external_id")).collect()] == [("s", "e", 2)]
    rows = spark.createDataFrame([(1, "pending", 0, "en"), (2, "odd", 6, None), (3, "ready", None, "x" * 17)], "id int, status string, rating int, language string")
    got = sorted((r.id, r.violation) for r in integrity.check_domain("reviews", rows).collect())
    assert got == [(1, "rating: outside 1..5"), (2, "language: null"), (2, "rating: outside 1..5"), (2, "status: not in domain"), (3, "language: longer than 16")]
    child = spark.createDataFrame([(1, "p", "o"), (2, "p", "x"), (3, None, "o")], "id int, product_id string, organization_id string")
    parent = spark.createDataFrame([("p", "o")], "id string, organization_id string")
    orphans = integrity.check_table_foreign_keys("import_jobs", {"import_jobs": child.withColumn("source_id", F.lit(None).cast("string")), "products": parent, "sources": parent.withColumn("product_id", F.lit("p"))})
    assert [r.id for r in orphans[("product_id", "organization_id")].collect()] == [2]


def test_sweeps_equal_the_single_checks(spark):
    tables = {
        "organizations": spark.createDataFrame([("o", "a"), ("q", "a"), ("r", None), ("t", None)], "id string, slug string"),
        "products": spark.createDataFrame([("p", "o", "k"), ("p", "o", "m"), ("x", "zz", "k"), (None, "o", "k")], "id string, organization_id string, key string"),
        "reviews": spark.createDataFrame([(1, "p", "o", "s", "e"), (2, "p", "q", "s", "e"), (3, None, "o", "s", None)], "id int, product_id string, organization_id string, source_id string, external_id string"),
    }
    found = sorted((r.table_name, r.rule, tuple(r.key), r.rows) for r in integrity.unique_sweep(tables).collect())
    single = [(name, ",".join(keys), tuple(str(r[k]) for k in keys), r.rows) for name, df in tables.items() for keys, bad in integrity.check_table_unique(name, df).items() for r in bad.collect()]
    assert found == sorted(single) and len(found) == 4
    orphans = sorted((r.table_name, r.rule, r.id) for r in integrity.foreign_key_sweep(tables).collect())
    assert orphans == [("products", "organization_id", "x"), ("reviews", "product_id,organization_id", "2")]
    plan = integrity.unique_sweep(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    domains = sorted((r.table_name, r.id, r.violation) for r in integrity.domain_sweep({"reviews": tables["reviews"].withColumn("rating", F.lit(9))}).collect() if "rating" in r.violation)
    assert domains == [("reviews", str(i), "rating: outside 1..5") for i in (1, 2, 3)]
    assert integrity.unique_sweep({}).collect() == integrity.foreign_key_sweep({}).collect() == []


def test_jobs(spark):
    rows = [(1, "pending", None, None, 0), (2, "pending", 990, None, 1), (3, "processing", None, 0, 1), (4, "pending", None, None, 5), (5, "failed", None, 0, 1)]
    df = spark.createDataFrame(rows, "id int, status string, d long, s long, attempts int").select(
        "id", "status", "attempts", F.timestamp_seconds("d").alias("dispatched_at"), F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("id").alias("created_at")
    )
    stale = jobs.stale_import_jobs(df, F.timestamp_seconds(F.lit(1800)))
    got = [(r.id, r.decision) for r in jobs.split_by_attempts(stale).orderBy("id").collect()]
    assert got == [(1, "retry"), (3, "retry"), (4, "exhausted")]


def test_streams_import_once_and_score_once(spark, tmp_path):
    def rule(df):
        return df.withColumn("label", F.lit("positive")).withColumn("score", F.lit(0.5))

    landing = tmp_path / "imports" / "org"
    landing.mkdir(parents=True)
    paths = {name: str(tmp_path / name) for name in ("reviews", "summary", "checkpoint", "sentiments", "scored", "errors")}

    def run():
        stream_import(
            spark, str(tmp_path / "imports"), "jsonl", paths["reviews"], paths["summary"], paths["checkpoint"],
            organization_id=F.regexp_extract("path", "imports/([^/]+)/", 1), product_id=F.lit("p"), source_id=F.lit("s"),
            ingested_at=F.timestamp_seconds(F.lit(1)), files_per_batch=1, errors_path=paths["errors"],
        ).awaitTermination()
        stream_score(spark, paths["reviews"], paths["sentiments"], paths["scored"], rule, "v1", F.timestamp_seconds(F.lit(2))).awaitTermination()

    (landing / "a.jsonl").write_text('{"text": "first text", "occurred_at": 1}\n{"text": "First text", "occurred_at": 1}\n')
    (landing / "b.jsonl").write_text('{"text": "first TEXT", "occurred_at": 1}\n{"text": "second text", "occurred_at": 1}\n')
    run()
    run()
    (landing / "broken.jsonl").write_bytes(b'{"text": "\xff", "occurred_at": 1}\n')
    (landing / "c.jsonl").write_text('{"text": "second text", "occurred_at": 1}\n{"text": "third text", "occurred_at": 1}\n')
    run()
    stored = read_table(spark, paths["reviews"], REVIEWS)
    assert sorted(r.text_normalized for r in stored.collect()) == ["first text", "second text", "third text"]
    summary = spark.read.parquet(paths["summary"])
    assert tuple(summary.selectExpr("sum(total_rows)", "sum(imported)", "sum(duplicates)").first()) == (6, 3, 3)
    assert [r.path.endswith("broken.jsonl") for r in summary.where("status = 'failed'").collect()] == [True]
    errors = spark.read.parquet(paths["errors"]).collect()
    assert [(r.path.endswith("broken.jsonl"), r.row_number, r.reason) for r in errors] == [(True, 0, "file is not valid UTF-8")]
    sentiments = read_table(spark, paths["sentiments"], REVIEW_SENTIMENTS)
    assert sorted(r.review_id for r in sentiments.collect()) == sorted(r.id for r in stored.collect())
