"""Registered queries of the training-data operators, each over its whole table, and their SQL.

An operator keeps its own interface; the query derives the columns asked of it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import byte_bpe, cover_tree, hard_negatives, mixing, ngram_join, packing, periodic_runs, quality, secrets, stable_search, tokenfile, toxicity, urls
from reviewmill.llm.labels import fold_of
from reviewmill.session import cut_lineage, scratch_path, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
MIX_WEIGHTS = (5, 2, 1)
MIX_ROUNDS = 3


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def text_files(docs: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Files to deal a table's texts into: by the planner's estimate of its size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_each))


@register()
def op1_stable_projections(spark: SparkSession, sf: str) -> DataFrame:
    return stable_search.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


@register()
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    held_out = fold_of(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@register()
def op3_bit_packed_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "tokens")
    tokenfile.write_tokens(docs, path, TOKENIZER, end=1, files=text_files(docs))
    return tokenfile.document_digests(tokenfile.read_tokens(spark, path))


@register()
def op4_cutting_stock_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), TOKENIZER, end=2, capacity=4096)


@register()
def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


COMPONENTS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * held >= 75 * (x.n + y.n - held)),
steps AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reached r JOIN steps s ON s.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) ON a = d.doc_id"""


@register(COMPONENTS_SQL)
def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf, "documents").select("doc_id", "text"), n=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id")


@register()
def op7_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    held_out = fold_of(F.col("doc_id")) == 0
    score = F.col("quality_score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


PRODUCTS_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
products AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY q.vec_id, c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM products)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10"""


@register(PRODUCTS_SQL)
def op8_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.transform("x", lambda c: F.floor(c * F.lit(1024.0)).cast("long"))
    return cover_tree.top_products(table(spark, sf, "embeddings"), "vec_id", "embedding", whole, F.col("vec_id") % 100 == 0, k=10)


def _span(s: F.Column) -> F.Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


@register()
def op9_secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("secrets", lambda s: s["kind"] != "entropy"), _span), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", _span), ",").alias("spans"),
    )


@register()
def op10_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    sized = cut_lineage(docs.select("doc_id", mixing.word_count(F.col("text")).alias("size"), "source"), "sizes")
    mixed, targets = mixing.mix_by_source(sized, "source", MIX_WEIGHTS, MIX_ROUNDS)
    return mixed.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", "taken", "rounds"
    )


NEGATIVES_SQL = """
WITH usable AS MATERIALIZED (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
products AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.i = c.i AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0
  GROUP BY a.vec_id, c.vec_id),
scored AS MATERIALIZED (
  SELECT p.*, a.label = c.label AS same FROM products p JOIN usable a ON a.vec_id = p.anchor_id JOIN usable c ON c.vec_id = p.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.*, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 3"""


@register(NEGATIVES_SQL)
def op11_hilbert_negatives(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("x", lambda c: F.floor(c * F.lit(256.0)).cast("long"))
    vectors = table(spark, sf, "embeddings")
    return hard_negatives.mine(vectors, "vec_id", "embedding", shifted, whole, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) with texts that loop, for ids whose crc32 ends in 0: from a word
    on, given by the crc32, a few words come again and again. Their words stay as many."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    found = found.withColumn("n", F.size("w"))  # -1 or NULL where there are no words to loop
    found = found.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")).cast("int"))
    found = found.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    loop = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    whole = F.concat_ws(" ", F.expr("slice(w, 1, a)"), loop)
    return found.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


@register()
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.detect(with_loops(table(spark, sf, "documents")))
    found = found.withColumn("top", F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.col2")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.col3")).alias("period"),
        F.expr("(1000 * top.length) div -top.col3").alias("exponent_milli"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@register()
def op13_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.decode(coded, BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
