"""The registered queries, each next to the SQL that has to give the same rows.

The given tables stand in for the review tables: documents are reviews (language as tenant,
source as product), labels are sentiments, regions own nations own suppliers as
organizations, products and sources, orders are import jobs, events are raw rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions import ids, vectors
from reviewmill.functions import text as X
from reviewmill.operators import (
    analytics,
    cellindex,
    dedup,
    embedding,
    features,
    incremental,
    integrity,
    jobs,
    language,
    relational,
    search,
    sentiment,
    validation,
)
from reviewmill.plans import importing, scoring, searching, training
from reviewmill.plans.preprocess import preprocess_reviews
from reviewmill.schemas import REVIEW_SENTIMENTS, REVIEWS
from reviewmill.session import cut_lineage, scratch_path, spread
from reviewmill.sources import corpora, registry, reviews as files, tables
from reviewmill.streaming.jobs import stream_embed, stream_import, stream_score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EPOCH_2024 = 1704067200


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


TEXT_TABLES = ("documents", "pages", "conversations", "events")
# Validating an event takes far longer than reading it.
EVENT_PIECE_ROWS = 50_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; text-heavy ones are single files here and get spread over the cores."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name == "events":
        return spread(df, EVENT_PIECE_ROWS)
    return spread(df) if name in TEXT_TABLES else df


# ---------------------------------------------------------------- tables standing in


def reviews_of(spark: SparkSession, sf: str) -> DataFrame:
    moment = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("organization_id"),
        F.col("source").alias("product_id"),
        F.col("lang").alias("source_id"),
        F.when(F.col("doc_id") % 10 != 0, F.floor(F.col("doc_id") / 2).cast("string")).alias("external_id"),
        "text",
        F.col("lang").alias("language"),
        F.lit(None).cast("smallint").alias("rating"),
        F.lit("pending").alias("status"),
        moment.alias("occurred_at"),
        moment.alias("created_at"),
    )


REVIEWS_SQL = f"""
reviews AS (
  SELECT doc_id AS id, lang AS organization_id, source AS product_id, lang AS source_id,
         CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id // 2 AS VARCHAR) END AS external_id,
         text, lang AS language, 'pending' AS status, {EPOCH_2024} + doc_id AS created
  FROM documents)"""


def sentiments_of(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    rows = table(spark, sf, "labels").join(reviews_of(spark, sf), F.col("doc_id") == F.col("id"))
    return rows.select(
        F.col("doc_id").alias("id"),
        "organization_id",
        "product_id",
        F.col("doc_id").alias("review_id"),
        F.lit("rule").alias("model_name"),
        F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
        label.alias("label"),
        (F.col("quality") * 0.5 + 0.25).alias("score"),
        "created_at",
    )


SENTIMENTS_SQL = f"""{REVIEWS_SQL},
sentiments AS (
  SELECT doc_id AS id, organization_id, product_id, doc_id AS review_id, 'rule' AS model_name,
         CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         quality * 0.5 + 0.25 AS score
  FROM labels JOIN reviews ON doc_id = reviews.id)"""


def embeddings_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("review_id"),
        F.col("label").cast("string").alias("product_id"),
        F.lit("v1").alias("model_version"),
        "embedding",
    )


def organizations_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("id"),
        F.col("r_name").alias("name"),
        F.lower("r_name").alias("slug"),
        F.lit("active").alias("status"),
        F.timestamp_seconds(F.col("r_regionkey").cast("long") * 86400).alias("created_at"),
    )


def products_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_regionkey").cast("long").alias("organization_id"),
        F.col("n_name").alias("name"),
        F.lower("n_name").alias("key"),
        F.lit("en").alias("default_language"),
        F.lit("UTC").alias("timezone"),
        F.lit("active").alias("status"),
        F.timestamp_seconds(F.col("n_nationkey").cast("long") % 7).alias("created_at"),
    )


def sources_of(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"),
        F.col("n_regionkey").cast("long").alias("organization_id"),
        F.col("s_nationkey").cast("long").alias("product_id"),
        F.col("s_name").alias("name"),
        F.lit("csv").alias("source_type"),
        F.col("s_name").alias("external_reference"),
        F.timestamp_seconds(F.col("s_suppkey") % 5).alias("created_at"),
    )


OWNERS_SQL = """
organizations AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(r_regionkey AS BIGINT) * 86400 AS created FROM region),
products AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS organization_id, n_name AS name,
                    CAST(n_nationkey AS BIGINT) % 7 AS created FROM nation),
sources AS (SELECT s_suppkey AS id, CAST(n_regionkey AS BIGINT) AS organization_id, CAST(s_nationkey AS BIGINT) AS product_id,
                   s_name AS name, s_suppkey % 5 AS created FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def import_jobs_of(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "processing")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("organization_id"),
        status.otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 7).alias("attempts"),
        F.when(F.col("o_orderkey") % 3 != 0, day).alias("dispatched_at"),
        day.alias("started_at"),
        day.alias("created_at"),
        F.col("o_custkey").alias("total_rows"),
        (F.col("o_custkey") - 1).alias("imported_count"),
        F.lit(1).alias("duplicate_count"),
        F.lit(0).alias("rejected_count"),
        F.when(F.col("o_orderstatus") == "F", "import failed").alias("error"),
    )


JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS id, o_orderpriority AS organization_id,
         CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
         o_orderkey % 7 AS attempts, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS dispatched_at,
         o_orderdate AS started_at, o_orderdate AS created_at, o_custkey AS total_rows,
         o_custkey - 1 AS imported_count, 1 AS duplicate_count, 0 AS rejected_count,
         CASE WHEN o_orderstatus = 'F' THEN 'import failed' END AS error
  FROM orders)"""


# ---------------------------------------------------------------- SQL for text


def sql_html(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in X.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def sql_urls(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)(?:https?://|www\.)\S+', ' ', 'g')"


def sql_space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_normal(x: str) -> str:
    return sql_space(sql_urls(sql_html(x)))


def sql_email(x: str) -> str:
    return rf"regexp_replace({x}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[a-zA-Z]{{2,}}', '[EMAIL]', 'g')"


def sql_phone(x: str) -> str:
    return rf"regexp_replace({x}, '(?:\B\+\d|\b\d)[\d\s().-]{{7,}}\d\b', '[PHONE]', 'g')"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


CLEAN_SQL = f"""{REVIEWS_SQL},
redacted AS MATERIALIZED (SELECT *, {sql_phone(sql_email(sql_normal('text')))} AS text_redacted FROM reviews),
clean AS MATERIALIZED (SELECT *, {sql_fold('text_redacted')} AS text_normalized, sha256({sql_fold('text_redacted')}) AS content_hash
          FROM redacted)"""


def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess_reviews(reviews_of(spark, sf)).withColumn("row_number", F.col("id"))


# ---------------------------------------------------------------- text functions


def _text_query(name: str, source: str, key: str, column: str, spark_fn: Callable[[Column], Column], sql: str) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, source).select(key, spark_fn(F.col(column)).alias("result"))

    query.__name__ = name
    register(f"SELECT {key}, {sql} AS result FROM {source}")(query)


WIDE = "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz")
_text_query("nfkc", "documents", "doc_id", "text", lambda c: X.nfkc(F.translate(c, "abcdefghijklmnopqrstuvwxyz ", WIDE + "\u3000")),
            "text")  # full-width letters and spaces become plain again
_text_query("strip_html", "pages", "page_id", "html", X.strip_html, sql_html("html"))
_text_query("strip_urls", "documents", "doc_id", "text", X.strip_urls, sql_urls("text"))
_text_query("collapse_whitespace", "pages", "page_id", "html", X.collapse_whitespace, sql_space("html"))
_text_query("normalize_text", "pages", "page_id", "html", X.normalize_text, sql_normal("html"))
_text_query("mask_email", "documents", "doc_id", "text", X.mask_email, sql_email("text"))
_text_query("mask_phone", "documents", "doc_id", "text", X.mask_phone, sql_phone("text"))
_text_query("casefold", "documents", "doc_id", "text", X.casefold, sql_fold("text"))
_text_query("content_hash", "documents", "doc_id", "text", X.content_hash, "sha256(text)")
_text_query("is_meaningful", "documents", "doc_id", "text", X.is_meaningful, "length(text) >= 3")


@register(f"""WITH {CLEAN_SQL}
SELECT id, language, text_redacted, text_normalized, content_hash, length(text_redacted) >= 3 AS is_meaningful FROM clean""")
def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return clean_reviews(spark, sf).select(
        "id", "language", "text_redacted", "text_normalized", "content_hash", "is_meaningful"
    )


@register(f"""WITH {CLEAN_SQL},
firsts AS (SELECT organization_id, content_hash, min(id) AS id FROM clean WHERE length(text_redacted) >= 3 GROUP BY ALL)
SELECT organization_id AS language, count(*) AS reviews, CAST(sum(id) AS BIGINT) AS id_sum FROM firsts GROUP BY ALL""")
def clean_reviews_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, mask, fold, hash, keep the first of each text, count by language."""
    rows = clean_reviews(spark, sf).where("is_meaningful").select("organization_id", "content_hash", "language", "row_number")
    firsts = dedup.dedup_in_batch(rows, order=("row_number",))
    return firsts.groupBy("language").agg(F.count(F.lit(1)).alias("reviews"), F.sum("row_number").alias("id_sum"))


LETTERS_SQL = r"lower(regexp_replace(' ' || text || ' ', '[^\p{L}]+', ' ', 'g'))"


@register(rf"""WITH padded AS (SELECT lang AS language, {LETTERS_SQL} AS t FROM documents),
groups AS (
  SELECT language, unnest(regexp_extract_all(t, '(?s)...')) AS letters FROM padded
  UNION ALL SELECT language, unnest(regexp_extract_all(substr(t, 2), '(?s)...')) FROM padded
  UNION ALL SELECT language, unnest(regexp_extract_all(substr(t, 3), '(?s)...')) FROM padded)
SELECT language, letters, count(*) AS n FROM groups GROUP BY ALL""")
def language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_profiles(table(spark, sf, "documents"), "text", "lang")


def _language_model(spark: SparkSession, sf: str) -> language.LanguageModel:
    labelled = table(spark, sf, "documents")
    return language.fit_language_model(cut_lineage(language.language_profiles(labelled, "text", "lang"), "profiles"))


def _groups_sql(source: str, keys: str) -> str:
    t = LETTERS_SQL
    parts = [f"SELECT {keys}, unnest(regexp_extract_all(substr({t}, {i}), '(?s)...')) AS letters FROM {source}" for i in (1, 2, 3)]
    return " UNION ALL ".join(parts)


@register(rf"""WITH labelled AS MATERIALIZED ({_groups_sql("documents", "lang")}),
profiles AS MATERIALIZED (SELECT lang, letters, count(*) AS n FROM labelled GROUP BY ALL),
totals AS (SELECT lang, sum(n) + (SELECT count(DISTINCT letters) FROM profiles) AS total FROM profiles GROUP BY lang),
asked AS MATERIALIZED (SELECT conv_id, turn, letters, count(*) AS m FROM ({_groups_sql("(SELECT * FROM conversations WHERE length(trim(text)) >= 3)", "conv_id, turn")}) GROUP BY ALL),
sizes AS (SELECT conv_id, turn, sum(m) AS groups FROM asked GROUP BY ALL),
known AS (SELECT conv_id, turn, lang, sum(m * ln(n + 1)) AS s FROM asked JOIN profiles USING (letters) GROUP BY ALL),
scored AS (SELECT z.conv_id, z.turn, t.lang, coalesce(k.s, 0) - z.groups * ln(t.total) AS score
           FROM sizes z CROSS JOIN totals t LEFT JOIN known k ON k.conv_id = z.conv_id AND k.turn = z.turn AND k.lang = t.lang),
best AS (SELECT conv_id, turn, lang FROM scored QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, lang DESC) = 1)
SELECT c.conv_id, c.turn, coalesce(b.lang, 'und') AS language FROM conversations c LEFT JOIN best b USING (conv_id, turn)""")
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    """Detected languages of the conversations, with profiles learned from the documents."""
    found = language.detect_language(table(spark, sf, "conversations"), _language_model(spark, sf), "text")
    return found.select("conv_id", "turn", "language")


@register("SELECT doc_id, lang AS language FROM documents")
def resolve_language(spark: SparkSession, sf: str) -> DataFrame:
    """One source does not declare its language; the others are learned from and kept."""
    docs = table(spark, sf, "documents").withColumn("language", F.when(F.col("source") != "src1", F.col("lang")))
    profiles = cut_lineage(language.language_profiles(docs), "profiles")
    return language.resolve_language(docs, language.fit_language_model(profiles), "text").select("doc_id", "language")


# ---------------------------------------------------------------- validation


def _written(value: Column, kind: str = "string") -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw rows, written in a different way for each event type."""
    kind = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    occurred = (
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(kind == "view", F.concat(stamp, F.lit("+03:00")))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when((kind == "purchase") & (F.col("user_id") % 5 == 0), F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(stamp)
    )
    number = F.floor("value").cast("string")
    rating = F.when(kind == "view", F.concat(number, F.lit(".0"))).when(kind == "signup", F.lit(" ")).otherwise(number)
    attributes = (
        F.when((kind == "error") & (F.col("user_id") % 4 == 0), F.lit("[1]"))
        .when(kind == "signup", F.lit(""))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select(
        F.lit("events").alias("path"),
        F.col("event_id").alias("row_number"),
        F.lit(None).cast("string").alias("parse_error"),
        _written(F.when((kind == "click") & (F.col("user_id") % 9 == 0), F.lit("  ")).otherwise(F.concat(F.lit(" "), kind, F.lit("\n")))).alias("text"),
        _written(occurred).alias("occurred_at"),
        _written(F.when(kind == "view", F.lit("  ")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(" ")))).alias("external_id"),
        _written(rating).alias("rating"),
        _written(F.lit("en")).alias("language"),
        _written(attributes).alias("attributes"),
    )


VALIDATED_SQL = """
parts AS (
  SELECT event_id, event_type, user_id, value, ts, floor(value) AS v,
    CASE WHEN event_type = 'click' AND user_id % 9 = 0 THEN 'text: Value error, text must not be blank' END AS text_error,
    CASE WHEN event_type = 'purchase' AND user_id % 5 = 0
         THEN 'occurred_at: Input should be a valid datetime or date, invalid character in year' END AS ts_error,
    CASE WHEN event_type <> 'signup' AND NOT floor(value) BETWEEN 1 AND 5
         THEN 'rating: Value error, rating must be between 1 and 5' END AS rating_error,
    CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 'attributes: Input should be a valid dictionary' END AS attr_error,
    CASE WHEN event_type = 'click' THEN date_trunc('minute', ts) WHEN event_type = 'view' THEN ts - INTERVAL 3 HOUR
         WHEN event_type = 'signup' THEN date_trunc('day', ts) ELSE ts END AS moment,
    CASE WHEN event_type = 'signup' THEN '{}' ELSE replace(props, ': ', ':') END AS attributes
  FROM events),
validated AS (
  SELECT event_id AS row_number, coalesce(text_error, ts_error, rating_error, attr_error) AS error,
    CASE WHEN text_error IS NULL THEN event_type END AS text,
    CASE WHEN ts_error IS NULL THEN epoch_us(moment) END AS occurred_us,
    CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS external_id,
    CASE WHEN event_type <> 'signup' AND rating_error IS NULL THEN CAST(v AS BIGINT) END AS rating,
    CASE WHEN attr_error IS NULL THEN attributes END AS attributes
  FROM parts)"""


@register(f"WITH {VALIDATED_SQL} SELECT * FROM validated")
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = validation.validate_rows(raw_events(spark, sf))
    return rows.select(
        "row_number", "error", "text", F.unix_micros("occurred_at").alias("occurred_us"), "external_id",
        F.col("rating").cast("long").alias("rating"), "attributes",
    )


def _field_query(name: str, field: str, check: Callable[[Column], tuple[Column, Column]], value: Callable[[Column], Column], sql: str) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found, problem = check(F.col(field))
        return raw_events(spark, sf).select("row_number", value(found).alias("value"), problem.alias("problem"))

    query.__name__ = name
    register(f"WITH {VALIDATED_SQL} {sql}")(query)


_field_query("validate_text", "text", validation.validate_text, lambda c: c,
             "SELECT event_id AS row_number, CASE WHEN text_error IS NULL THEN event_type END AS value, substr(text_error, 7) AS problem FROM parts")
_field_query("parse_occurred_at", "occurred_at", validation.parse_occurred_at, F.unix_micros,
             "SELECT event_id AS row_number, CASE WHEN ts_error IS NULL THEN epoch_us(moment) END AS value, substr(ts_error, 14) AS problem FROM parts")
_field_query("parse_rating", "rating", validation.parse_rating, lambda c: c.cast("long"),
             "SELECT event_id AS row_number, CASE WHEN event_type <> 'signup' AND rating_error IS NULL THEN CAST(v AS BIGINT) END AS value, substr(rating_error, 9) AS problem FROM parts")
_field_query("blank_to_null", "external_id", validation.optional_text, lambda c: c,
             "SELECT event_id AS row_number, CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS value, CAST(NULL AS VARCHAR) AS problem FROM parts")


@register(f"WITH {VALIDATED_SQL} SELECT event_id AS row_number, CASE WHEN attr_error IS NULL THEN attributes END AS value, substr(attr_error, 13) AS problem FROM parts")
def parse_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = validation.parse_attributes(raw_events(spark, sf))
    return rows.select("row_number", F.col("_attributes").alias("value"), F.col("_attributes_problem").alias("problem"))


@register(f"WITH {VALIDATED_SQL} SELECT row_number, error AS reason FROM validated WHERE error IS NOT NULL")
def split_valid(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = validation.split_valid(validation.validate_rows(raw_events(spark, sf)))
    return errors.select("row_number", "reason")


# ---------------------------------------------------------------- sources and sinks


def _stored_text(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as written-out review records."""
    return table(spark, sf, "conversations").select(
        "text",
        F.concat(F.lit("2026-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0")).alias("occurred_at"),
        F.concat_ws("-", "conv_id", "turn").alias("external_id"),
        F.when(F.col("role") == "user", "4").alias("rating"),
    )


STORED_SQL = """
SELECT conv_id || '-' || turn AS external_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text,
       epoch_us(TIMESTAMP '2026-01-01') + turn * 1000000 AS occurred_us,
       CASE WHEN role = 'user' THEN 4 END AS rating, CAST(NULL AS VARCHAR) AS error
FROM conversations"""


def _read_back(raw: DataFrame) -> DataFrame:
    rows = validation.validate_rows(raw)
    return rows.select(
        "external_id", "text", F.unix_micros("occurred_at").alias("occurred_us"),
        F.col("rating").cast("long").alias("rating"), "error",
    )


@register(STORED_SQL)
def read_reviews_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    _stored_text(spark, sf).write.options(header=True, escape='"').csv(path)
    return _read_back(files.read_reviews(spark, path, "csv"))


@register(STORED_SQL)
def read_reviews_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    _stored_text(spark, sf).write.json(path)
    return _read_back(files.read_reviews(spark, path, "jsonl"))


# An array file is read whole by one task; a file of its own per conversation costs more to open than to read.
ARRAY_RECORDS = 5_000


def write_arrays(records: DataFrame, path: str, per_file: int = ARRAY_RECORDS) -> None:
    """Records as JSON array files. Their number, not their size, grows with the input."""
    files = max(1, -(-records.count() // per_file))
    objects = records.select(F.to_json(F.struct("*")).alias("o"), F.pmod(F.xxhash64("external_id"), F.lit(files)).alias("file"))
    arrays = objects.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)


@register(STORED_SQL)
def read_reviews_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Array files of about ARRAY_RECORDS records, each file a single JSON value."""
    path = scratch_path(spark, "json")
    write_arrays(_stored_text(spark, sf), path)
    return _read_back(files.read_reviews(spark, path, "json"))


@register("""SELECT text, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label
FROM documents JOIN labels USING (doc_id)""")
def read_labelled(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    examples_of(spark, sf).select("text", "label").write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return corpora.read_labelled(spark, path)


@register("SELECT text FROM conversations")
def read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    rows = table(spark, sf, "conversations").select("role", "text")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return corpora.read_corpus(spark, path)


@register(f"""WITH {CLEAN_SQL} SELECT text_normalized AS text FROM clean
WHERE organization_id = 'en' AND product_id = 'src2'""")
def read_corpus_from_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.read_corpus_from_reviews(clean_reviews(spark, sf), "en", "src2")


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(clean_reviews(spark, sf).where("is_meaningful"), "cleaned")
    kept = dedup.ordered_dual_key_dedup(rows, order=("row_number",))
    return rows.join(kept, ["row_number"], "left_semi")


DUAL_SQL = f"""WITH RECURSIVE {CLEAN_SQL},
ordered AS MATERIALIZED (
  SELECT id, organization_id || '|' || content_hash AS h, source_id || '|' || external_id AS e,
         row_number() OVER (ORDER BY id) AS rn
  FROM clean WHERE length(text_redacted) >= 3),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, false AS taken,
         CAST([] AS VARCHAR[]) AS hs, CAST([] AS VARCHAR[]) AS es
  UNION ALL
  SELECT o.rn, o.id, NOT (list_contains(hs, h) OR coalesce(list_contains(es, e), false)),
         CASE WHEN list_contains(hs, h) OR coalesce(list_contains(es, e), false) THEN hs ELSE list_append(hs, h) END,
         CASE WHEN list_contains(hs, h) OR coalesce(list_contains(es, e), false) OR e IS NULL THEN es ELSE list_append(es, e) END
  FROM walk JOIN ordered o ON o.rn = walk.rn + 1),
accepted AS MATERIALIZED (SELECT id FROM walk WHERE taken)"""


@register(f"{DUAL_SQL} SELECT id, organization_id, product_id, external_id, content_hash, 'pending' AS status FROM clean WHERE id IN (SELECT id FROM accepted)")
def append_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted reviews, appended to a partitioned table and read back."""
    path = scratch_path(spark, "reviews")
    tables.append_reviews(_accepted(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.select("id", "organization_id", "product_id", "external_id", "content_hash", "status")


@register("SELECT lang AS organization_id, count(*) AS reviews FROM documents GROUP BY ALL")
def landing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenant's reviews landed under a path of its own, and counted from their paths."""
    root = scratch_path(spark, "landing")
    docs = table(spark, sf, "documents").select("lang", F.to_json(F.struct("text")).alias("value"))
    landed = []
    for (tenant,) in docs.select("lang").distinct().collect():
        landed.append(tables.landing_path(root, tenant, "jsonl"))
        docs.where(F.col("lang") == tenant).select("value").write.text(landed[-1])
    tables.require_files(spark, landed)
    lines = spark.read.text(landed)
    owner = tables.landing_owner(F.col("_metadata.file_path"))
    return lines.groupBy(owner.alias("organization_id")).agg(F.count(F.lit(1)).alias("reviews"))


# ---------------------------------------------------------------- dedup and import


@register(f"""WITH {CLEAN_SQL} SELECT id FROM clean QUALIFY row_number() OVER (PARTITION BY organization_id, content_hash ORDER BY id) = 1""")
def dedup_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_reviews(spark, sf).select("id", "organization_id", "content_hash", "row_number")
    return dedup.dedup_in_batch(rows, order=("row_number",)).select("id")


def _keyed_reviews(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The keys of all reviews, cleaned once, and of those that were stored earlier: the labelled ones."""
    rows = cut_lineage(clean_reviews(spark, sf).select("id", "organization_id", "content_hash", "row_number"), "keyed")
    return rows, rows.join(table(spark, sf, "labels"), F.col("id") == F.col("doc_id"), "left_semi")


@register(f"""WITH {CLEAN_SQL} SELECT id FROM clean c WHERE EXISTS (SELECT 1 FROM clean s JOIN labels ON s.id = doc_id
WHERE s.organization_id = c.organization_id AND s.content_hash = c.content_hash)""")
def exists_with_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = _keyed_reviews(spark, sf)
    return dedup.already_stored(rows, stored, order=("row_number",)).select("id")


@register(f"""WITH {CLEAN_SQL} SELECT id FROM clean c WHERE NOT EXISTS (SELECT 1 FROM clean s JOIN labels ON s.id = doc_id
WHERE s.organization_id = c.organization_id AND s.content_hash = c.content_hash)""")
def dedup_against_existing(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = _keyed_reviews(spark, sf)
    return dedup.dedup_against_existing(rows, stored, order=("row_number",)).select("id")


@register(f"""WITH {REVIEWS_SQL} SELECT id FROM reviews
QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) = 1""")
def dedup_external_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews_of(spark, sf).withColumn("row_number", F.col("id"))
    return dedup.dedup_external_id(rows, order=("row_number",)).select("id")


@register(f"{DUAL_SQL} SELECT id FROM accepted")
def ordered_dual_key_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_reviews(spark, sf).where("is_meaningful")
    return dedup.ordered_dual_key_dedup(rows, order=("row_number",)).withColumnRenamed("row_number", "id")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews_of(spark, sf).select(
        F.lit(None).cast("string").alias("error"), F.col("product_id").alias("path"), F.col("id").alias("row_number"),
        "organization_id", "product_id", "source_id", "external_id", "text", "language", "rating", "occurred_at",
        F.lit("{}").alias("attributes"),
    )
    return importing.classify_import(rows, order=("row_number",))


CLASSIFIED_SQL = f"""{DUAL_SQL},
classified AS (
  SELECT clean.id AS row_number, product_id AS path,
         CASE WHEN length(text_redacted) < 3 THEN 'text too short after cleaning' END AS reason,
         CASE WHEN length(text_redacted) < 3 THEN 'rejected' WHEN accepted.id IS NOT NULL THEN 'imported' ELSE 'duplicate' END AS outcome
  FROM clean LEFT JOIN accepted ON accepted.id = clean.id)"""


@register(f"{CLASSIFIED_SQL} SELECT row_number, outcome, reason FROM classified")
def classify_import(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("row_number", "outcome", "reason")


@register(f"""{CLASSIFIED_SQL} SELECT path, count(*) AS total_rows, count(*) FILTER (outcome = 'imported') AS imported,
count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'rejected') AS rejected FROM classified GROUP BY path""")
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return importing.import_summary(_classified(spark, sf))


@register(f"""WITH {VALIDATED_SQL} SELECT row_number, coalesce(error, 'text too short after cleaning') AS reason
FROM validated WHERE error IS NOT NULL OR length(text) < 3""")
def import_errors(spark: SparkSession, sf: str) -> DataFrame:
    owned = validation.validate_rows(raw_events(spark, sf)).withColumns(
        {"organization_id": F.lit("o"), "product_id": F.lit("p"), "source_id": F.lit("s")}
    )
    return importing.import_errors(importing.classify_import(owned)).select("row_number", "reason")


def _landed(spark: SparkSession, sf: str) -> str:
    """Documents as JSON Lines files, one folder per tenant."""
    root = scratch_path(spark, "landing")
    rows = table(spark, sf, "documents").select(
        F.col("lang").alias("organization_id"), "text", F.lit("2026-01-01T00:00:00Z").alias("occurred_at"),
        F.col("lang").alias("language"),
    )
    rows.repartition(8).write.partitionBy("organization_id").json(f"{root}/imports")
    return root


def _owner() -> dict[str, Column]:
    tenant = tables.landing_owner(F.col("path"))
    return {"organization_id": tenant, "product_id": F.lit("product"), "source_id": tenant}


FILES_SQL = f"""WITH {CLEAN_SQL},
counted AS (SELECT organization_id, count(*) AS total_rows, count(*) FILTER (length(text_redacted) < 3) AS rejected,
                   count(DISTINCT content_hash) FILTER (length(text_redacted) >= 3) AS imported FROM clean GROUP BY ALL)
SELECT organization_id, total_rows, imported, total_rows - imported - rejected AS duplicates, rejected FROM counted"""


@register(FILES_SQL)
def import_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The whole import job over files, summed up per tenant."""
    result = importing.import_reviews(
        spark, f"{_landed(spark, sf)}/imports/*/*.json", "jsonl", **_owner(), ingested_at=F.timestamp_seconds(F.lit(EPOCH_2024))
    )
    return importing.import_summary(result.classified, by=("organization_id",))


# ---------------------------------------------------------------- relational reads


@register(f"WITH {REVIEWS_SQL} SELECT id, product_id FROM reviews WHERE organization_id = 'de'")
def tenant_scope(spark: SparkSession, sf: str) -> DataFrame:
    return relational.tenant_scope(reviews_of(spark, sf), "de").select("id", "product_id")


@register(f"WITH {REVIEWS_SQL} SELECT organization_id, count(*) AS refused FROM reviews WHERE organization_id IS DISTINCT FROM 'de' GROUP BY ALL")
def check_tenant_writes(spark: SparkSession, sf: str) -> DataFrame:
    refused = relational.check_tenant_writes(reviews_of(spark, sf), "de")
    return refused.groupBy("organization_id").agg(F.count(F.lit(1)).alias("refused"))


@register(f"WITH {REVIEWS_SQL} SELECT id, product_id, text FROM reviews WHERE id = 7 AND organization_id = (SELECT lang FROM documents WHERE doc_id = 7)")
def get_by_id(spark: SparkSession, sf: str) -> DataFrame:
    reviews = reviews_of(spark, sf)
    tenant = relational.get_by_id(reviews, 7).first().organization_id
    return relational.get_by_id(reviews, 7, tenant).select("id", "product_id", "text")


@register(f"WITH {OWNERS_SQL} SELECT id, name FROM organizations ORDER BY created DESC, id LIMIT 3 OFFSET 1")
def list_organizations(spark: SparkSession, sf: str) -> DataFrame:
    return relational.list_organizations(organizations_of(spark, sf), limit=3, offset=1).select("id", "name")


@register(f"WITH {OWNERS_SQL} SELECT id, name FROM products WHERE organization_id = 2 ORDER BY created DESC, id LIMIT 100")
def list_products(spark: SparkSession, sf: str) -> DataFrame:
    return relational.list_products(products_of(spark, sf), 2).select("id", "name")


@register(f"WITH {OWNERS_SQL} SELECT id, name FROM sources WHERE organization_id = 2 AND product_id = 7 ORDER BY created DESC, id")
def list_sources_for_product(spark: SparkSession, sf: str) -> DataFrame:
    return relational.list_sources_for_product(sources_of(spark, sf), 2, 7).select("id", "name")


@register(f"WITH {REVIEWS_SQL} SELECT id, text FROM reviews WHERE organization_id = 'en' AND product_id = 'src7' ORDER BY created DESC, id LIMIT 100")
def list_reviews_for_product(spark: SparkSession, sf: str) -> DataFrame:
    return relational.list_reviews_for_product(reviews_of(spark, sf), "en", "src7").select("id", "text")


@register(f"""WITH {OWNERS_SQL}
SELECT c_custkey AS id, CASE WHEN o.id IS NULL THEN 'organization not found' WHEN p.id IS NULL THEN 'product not found'
       WHEN s.id IS NULL THEN 'source not found for product' END AS problem
FROM customer LEFT JOIN organizations o ON o.id = c_custkey % 6
LEFT JOIN products p ON p.id = c_nationkey AND p.organization_id = c_custkey % 6
LEFT JOIN sources s ON s.id = c_custkey % 50 AND s.product_id = c_nationkey AND s.organization_id = c_custkey % 6""")
def valid_source_chain(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 6).alias("organization_id"),
        F.col("c_nationkey").cast("long").alias("product_id"), (F.col("c_custkey") % 50).alias("source_id"),
    )
    checked = relational.valid_source_chain(
        requests, organizations_of(spark, sf), products_of(spark, sf), sources_of(spark, sf)
    )
    return checked.select("id", "problem")


# ---------------------------------------------------------------- incremental work


PENDING_SQL = f"""WITH {SENTIMENTS_SQL}
SELECT id FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM sentiments s WHERE s.review_id = r.id
  AND s.organization_id = r.organization_id AND s.model_version = 'v1')"""


@register(PENDING_SQL)
def pending_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Everything still to score, over all tenants and products."""
    return incremental.pending_for_sentiment(reviews_of(spark, sf), sentiments_of(spark, sf), "v1").select("id")


@register(PENDING_SQL + " AND organization_id = 'en' AND product_id = 'src3' ORDER BY created, id LIMIT 500")
def pending_for_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    todo = incremental.pending_for_sentiment(
        reviews_of(spark, sf), sentiments_of(spark, sf), "v1", organization_id="en", product_id="src3", limit=500
    )
    return todo.select("id")


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    owners = reviews_of(spark, sf).select(F.col("id").alias("review_id"), "organization_id")
    return embeddings_of(spark, sf).drop("product_id").join(owners, "review_id")


@register(f"""WITH {REVIEWS_SQL} SELECT id FROM reviews WHERE id NOT IN (SELECT vec_id FROM embeddings)
AND organization_id = 'fr' AND product_id = 'src5' ORDER BY created, id LIMIT 500""")
def pending_for_embedding(spark: SparkSession, sf: str) -> DataFrame:
    todo = incremental.pending_for_embedding(
        reviews_of(spark, sf), _embedded(spark, sf), "v1", organization_id="fr", product_id="src5", limit=500
    )
    return todo.select("id")


@register(f"""WITH {SENTIMENTS_SQL},
incoming AS (SELECT id, 'v1' AS model_version, CASE WHEN id % 4 = 0 THEN 'neutral' ELSE 'positive' END AS label FROM reviews)
SELECT coalesce(s.review_id, i.id) AS review_id, coalesce(s.model_version, i.model_version) AS model_version,
       coalesce(s.model_name, 'new') AS model_name, coalesce(i.label, s.label) AS label,
       CASE WHEN i.id IS NULL THEN CAST(s.score AS DOUBLE) ELSE 0.5 END AS score
FROM sentiments s FULL JOIN incoming i ON i.id = s.review_id AND i.model_version = s.model_version""")
def upsert_sentiments(spark: SparkSession, sf: str) -> DataFrame:
    incoming = reviews_of(spark, sf).select(
        "id", "organization_id", "product_id", F.col("id").alias("review_id"), F.lit("new").alias("model_name"),
        F.lit("v1").alias("model_version"), F.when(F.col("id") % 4 == 0, "neutral").otherwise("positive").alias("label"),
        F.lit(0.5).alias("score"), "created_at",
    )
    merged = incremental.upsert_sentiments(sentiments_of(spark, sf), incoming)
    return merged.select("review_id", "model_version", "model_name", "label", F.col("score").cast("double").alias("score"))


@register("""SELECT vec_id AS review_id, 'v1' AS model_version,
round(CASE WHEN vec_id % 2 = 0 THEN -list_sum(CAST(embedding AS DOUBLE[])) ELSE list_sum(CAST(embedding AS DOUBLE[])) END, 6) AS total FROM embeddings
UNION ALL SELECT vec_id, 'v2', round(-list_sum(CAST(embedding AS DOUBLE[])), 6) FROM embeddings WHERE vec_id % 2 = 1""")
def upsert_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Even vectors are replaced by their negatives; odd ones get a row of a new version."""
    stored = embeddings_of(spark, sf)
    incoming = stored.withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn(
        "model_version", F.when(F.col("review_id") % 2 == 0, "v1").otherwise("v2")
    )
    merged = incremental.upsert_embeddings(stored, incoming)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return merged.select("review_id", "model_version", F.round(total, 6).alias("total"))


@register("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'ready' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def mark_ready(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.mark_ready(reviews_of(spark, sf), sentiments_of(spark, sf)).select("id", "status")


def rule_analyzer(df: DataFrame) -> DataFrame:
    """A stand-in scorer: the first letter of the folded text decides."""
    first = F.substring("text_normalized", 1, 1)
    label = F.when(first < "e", "negative").when(first < "n", "neutral").otherwise("positive")
    return df.withColumn("label", label).withColumn("score", F.lit(0.75))


RULE_SQL = f"""{CLEAN_SQL.replace(REVIEWS_SQL, SENTIMENTS_SQL)},
scored AS (SELECT id, organization_id, CASE WHEN substr(text_normalized, 1, 1) < 'e' THEN 'negative'
             WHEN substr(text_normalized, 1, 1) < 'n' THEN 'neutral' ELSE 'positive' END AS label
           FROM clean c WHERE NOT EXISTS (SELECT 1 FROM sentiments s WHERE s.review_id = c.id AND s.model_version = 'v1'))"""


def _run_analysis(spark: SparkSession, sf: str) -> scoring.SentimentRun:
    return scoring.analyze_pending(
        clean_reviews(spark, sf), sentiments_of(spark, sf), rule_analyzer, "v1", F.timestamp_seconds(F.lit(EPOCH_2024))
    )


@register(f"WITH {RULE_SQL} SELECT id AS review_id, label FROM scored UNION ALL SELECT review_id, label FROM sentiments")
def analyze_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Score the backlog with a rule and merge the results with the stored ones."""
    run = _run_analysis(spark, sf)
    return run.sentiments.select("review_id", "label")


@register(f"WITH {RULE_SQL} SELECT label, count(*) AS count FROM scored GROUP BY label")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _run_analysis(spark, sf).counts


# ---------------------------------------------------------------- aggregations


@register(f"WITH {SENTIMENTS_SQL} SELECT organization_id, product_id, model_version, label, count(*) AS count FROM sentiments GROUP BY ALL")
def sentiment_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.sentiment_distribution(sentiments_of(spark, sf))


@register(f"""WITH {SENTIMENTS_SQL},
counted AS (SELECT organization_id, product_id, model_version, label, count(*) AS count FROM sentiments GROUP BY ALL),
summed AS (SELECT *, CAST(sum(count) OVER (PARTITION BY organization_id, product_id, model_version) AS BIGINT) AS total FROM counted)
SELECT *, round_even(CAST(count AS DOUBLE) / total * 100, 1) AS percentage FROM summed""")
def sentiment_percentages(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.sentiment_percentages(analytics.sentiment_distribution(sentiments_of(spark, sf)))


# ---------------------------------------------------------------- sentiment model


def examples_of(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return docs.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "n_chars", label.alias("label"))


TERMS_SQL = r"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
terms AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w)-1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(w) > 1),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM counts GROUP BY term)"""


@register(f"""WITH {TERMS_SQL},
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS r FROM counts JOIN idf USING (term))
SELECT doc_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""")
def tfidf_features(spark: SparkSession, sf: str) -> DataFrame:
    found = features.tfidf_features(table(spark, sf, "documents"), "doc_id")
    # as round(weight, 6), which makes a decimal of every number first
    return found.select(F.col("id").alias("doc_id"), "term", (F.rint(F.col("weight") * 1e6) / 1e6).alias("weight"))


@register(f"WITH {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def inverse_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    frequencies, documents = features.document_frequency_by_id(table(spark, sf, "documents"), "doc_id")
    idf = features.inverse_document_frequency(frequencies, documents)
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@register(f"""WITH {SENTIMENTS_SQL}, c AS (SELECT label, count(*) AS n FROM sentiments GROUP BY label)
SELECT label, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 9) AS weight FROM c""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.class_weights(examples_of(spark, sf)).select("label", F.round("weight", 9).alias("weight"))


def scored_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a label guessed from their length."""
    guess = F.when(F.col("n_chars") < 1200, "negative").when(F.col("n_chars") < 1800, "neutral").otherwise("positive")
    return examples_of(spark, sf).select(F.col("label").alias("truth"), guess.alias("label"))


EVALUATED_SQL = """
scored AS (SELECT CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS truth,
                  CASE WHEN n_chars < 1200 THEN 'negative' WHEN n_chars < 1800 THEN 'neutral' ELSE 'positive' END AS label
           FROM documents JOIN labels USING (doc_id)),
names AS (SELECT unnest(['negative', 'neutral', 'positive']) AS name),
metrics AS (
  SELECT name, count(*) FILTER (truth = name AND label = name) AS hit, count(*) FILTER (label = name) AS called,
         count(*) FILTER (truth = name) AS support FROM names CROSS JOIN scored GROUP BY name),
rates AS (SELECT name AS label, CASE WHEN called > 0 THEN hit / called::DOUBLE ELSE 0 END AS precision,
                 CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall, support, hit FROM metrics),
full_rates AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates)"""


@register(f"""WITH {EVALUATED_SQL} SELECT name AS truth, count(*) FILTER (truth = name AND label = 'negative') AS negative,
count(*) FILTER (truth = name AND label = 'neutral') AS neutral, count(*) FILTER (truth = name AND label = 'positive') AS positive
FROM names CROSS JOIN scored GROUP BY name""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.confusion_matrix(scored_examples(spark, sf)).drop("position")


@register(f"WITH {EVALUATED_SQL} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM full_rates")
def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = sentiment.label_metrics(sentiment.confusion_matrix(scored_examples(spark, sf)))
    return found.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register(f"""WITH {EVALUATED_SQL} SELECT round(CAST(sum(hit) AS DOUBLE) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1,
CAST(sum(support) AS BIGINT) AS sample_count FROM full_rates""")
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    summary = sentiment.evaluate(scored_examples(spark, sf)).summary
    return summary.select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"), "sample_count")


@register()
def fit_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the labelled documents; the model's labels and intercepts."""
    model = sentiment.fit_sentiment(examples_of(spark, sf))
    rows = list(zip(model.labels, model.intercepts, strict=True))
    return spark.createDataFrame(rows, "label string, intercept double")


@register("SELECT doc_id, true AS known_label, true AS score_in_range FROM documents")
def predict_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Score every document with a model fitted on the labelled ones: the label is one of the
    model's, and the score, being the largest of k probabilities, at least 1 / k."""
    model = sentiment.fit_sentiment(examples_of(spark, sf))
    scored = sentiment.predict_sentiment(table(spark, sf, "documents"), model)
    least = 1 / len(model.labels) - 1e-9
    return scored.select("doc_id", F.col("label").isin(*model.labels).alias("known_label"), F.col("score").between(least, 1 + 1e-9).alias("score_in_range"))


@register()
def predicted_sentiments(spark: SparkSession, sf: str) -> DataFrame:
    """Label and score of every document, by a model fitted on the labelled ones."""
    model = sentiment.fit_sentiment(examples_of(spark, sf))
    return sentiment.predict_sentiment(table(spark, sf, "documents").select("doc_id", "text"), model).select("doc_id", "label", "score")


@register(f"""WITH {SENTIMENTS_SQL}, c AS (SELECT label, count(*) AS n FROM sentiments GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS labelled, round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS majority_share, true AS beats_majority, true AS every_label_found FROM c""")
def sentiment_fit_quality(spark: SparkSession, sf: str) -> DataFrame:
    """What no constant model reaches: on its own labelled rows the fitted one is right more often
    than the commonest label is, and finds rows of every label."""
    examples = examples_of(spark, sf).select("text", F.col("label").alias("truth"))
    scored = sentiment.predict_sentiment(examples, sentiment.fit_sentiment(examples, label="truth"))
    counts = cut_lineage(scored.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("label")).alias("hit")), "fit-quality")
    majority = F.max("n") / F.sum("n")
    return counts.agg(
        F.sum("n").alias("labelled"), F.round(majority, 9).alias("majority_share"),
        (F.sum("hit") / F.sum("n") > majority).alias("beats_majority"), (F.min("hit") > 0).alias("every_label_found"),
    )


@register()
def train_on_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on what ``labels`` marks for even ids, evaluate on odd ids; the measured figures, whether
    or not they reach the gate."""
    examples = examples_of(spark, sf)
    train, held_out = (examples.where(F.col("doc_id") % 2 == i).select("text", "label") for i in (0, 1))
    _, evaluation = training.train_and_evaluate(train, held_out)
    gate = (F.col("macro_f1") >= training.MACRO_F1_GATE).alias("reached_gate")
    return evaluation.summary.select("sample_count", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), gate)


@register("""SELECT CAST(count(*) AS BIGINT) AS sample_count, true AS reached_gate, true AS report_agrees
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1""")
def train_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the labelled documents with even ids, publish if the odd ones reach the gate; the
    stored model is read back, scores the odd ones again and agrees with the stored report.
    What is learned is the language, given as sentiment labels: it follows from the text."""
    by_language = F.when(F.col("lang") == "en", "negative").when(F.col("lang") == "de", "neutral").otherwise("positive")
    examples = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "text", by_language.alias("label"))
    train, held_out = examples.where("doc_id % 2 = 0"), examples.where("doc_id % 2 = 1")
    root = scratch_path(spark, "registry")
    training.publish_sentiment(spark, root, "v1", train.select("text", "label"), held_out.select("text", "label"))
    model = registry.load_sentiment_model(spark, root, "v1")
    report = registry.load_report(spark, root, "v1")
    summary = sentiment.evaluate(sentiment.predict_sentiment(held_out.select("text", F.col("label").alias("truth")), model)).summary
    reached = F.col("macro_f1") >= training.MACRO_F1_GATE
    agrees = F.abs(F.col("macro_f1") - F.lit(report["macro_f1"])) < 1e-9
    return summary.select("sample_count", reached.alias("reached_gate"), agrees.alias("report_agrees"))


# ---------------------------------------------------------------- embeddings and search


@register("""SELECT vec_id, 256 AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS head, CAST(0 AS DOUBLE) AS tail,
round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings""")
def pad_vector(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "embeddings").withColumn("p", vectors.pad_vector("embedding", 256))
    squares = F.aggregate("p", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return padded.select(
        "vec_id", F.size("p").alias("width"), F.round(F.col("p")[0].cast("double"), 6).alias("head"),
        F.col("p")[255].cast("double").alias("tail"), F.round(F.sqrt(squares), 6).alias("norm"),
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of each label."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"])
    return means.groupBy("label").agg(ordered.alias("centroid"))


CENTROIDS_SQL = """
cells AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i),
centroids AS (SELECT label, list(m ORDER BY i) AS centroid FROM means GROUP BY label)"""


@register(f"""WITH {CENTROIDS_SQL} SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS similarity
FROM embeddings JOIN centroids USING (label)""")
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """How close each vector is to the mean of its label."""
    joined = table(spark, sf, "embeddings").join(centroids(spark, sf), "label")
    similarity = vectors.cosine_similarity(F.col("embedding").cast("array<double>"), F.col("centroid"))
    return joined.select("vec_id", F.round(similarity, 6).alias("similarity"))


def _vector(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@register(f"""WITH {CLEAN_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
SELECT id AS review_id, language, text_redacted, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS similarity
FROM embeddings CROSS JOIN q JOIN clean ON id = vec_id ORDER BY similarity DESC, vec_id LIMIT 10""")
def search_similar(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search_similar(
        embeddings_of(spark, sf), clean_reviews(spark, sf), _vector(spark, sf, 0), 10, model_version="v1"
    )
    return hits.select("review_id", "language", "text_redacted", F.round("similarity", 6).alias("similarity"))


@register(f"""WITH {CENTROIDS_SQL}, pairs AS (
SELECT c.label AS query_id, vec_id AS review_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS similarity
FROM embeddings CROSS JOIN centroids c)
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, review_id) <= 10""")
def search_many(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors to the mean of every label."""
    asked = centroids(spark, sf).select(F.col("label").alias("query_id"), F.col("centroid").alias("embedding"))
    hits = search.search_many(embeddings_of(spark, sf), asked, 10)
    return hits.select("query_id", "review_id", F.round("similarity", 6).alias("similarity"))


def _recall(found: DataFrame, exact: DataFrame, asked: int, least: float) -> DataFrame:
    """``hits`` of a search and whether it found enough of what an exact one finds."""
    same = found.join(exact.select("review_id"), "review_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("hits")).crossJoin(same.agg((F.count(F.lit(1)) >= least * asked).alias("recall_reached")))


@register("SELECT CAST(10 AS BIGINT) AS hits, true AS recall_reached")
def ann_search(spark: SparkSession, sf: str) -> DataFrame:
    """Ten approximate neighbours of every id divisible by 50, at least 0.9 of them among the true
    ten: the fewest of any id, and whether the recall is reached."""
    found, exact = _ann_neighbours(spark, sf)
    same = found.join(exact.select("query_id", "review_id"), ["query_id", "review_id"], "left_semi")
    counts = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    for name, rows in (("hits", found), ("same", same)):
        counts = counts.join(rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)), "query_id", "left")
    recall = F.sum(F.coalesce("same", F.lit(0))) / F.sum("asked")
    return counts.agg(F.min(F.coalesce("hits", F.lit(0))).alias("hits"), (recall >= 0.9).alias("recall_reached"))


@register()
def ann_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate neighbours themselves, each with its place in the exact order (NULL beyond ten)."""
    found, exact = _ann_neighbours(spark, sf)
    place = exact.select("query_id", "review_id", F.col("rank").alias("exact_rank"))
    return found.join(place, ["query_id", "review_id"], "left").select("query_id", "review_id", F.round("similarity", 6).alias("similarity"), "rank", "exact_rank")


def _ann_neighbours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    stored = embeddings_of(spark, sf)
    index = cellindex.build_index(stored, scratch_path(spark, "cells"))
    asked = stored.where(F.col("review_id") % 50 == 0).select(F.col("review_id").alias("query_id"), "embedding")
    found = cellindex.ann_search_many(spark, index, asked, 10), search.search_many(stored, asked, 10)
    return tuple(cut_lineage(rows, "neighbours") for rows in found)


def _shape(rows: DataFrame, *keys: str) -> DataFrame:
    """The width of every embedding, and whether its length is 1, or 0 for a text without known terms."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = (F.abs(length - 1) < 1e-4) | (length == 0)
    return rows.select(*keys, F.size("embedding").alias("width"), unit.alias("unit_or_zero"))


@register(r"""SELECT conv_id, turn, 64 AS width, true AS unit_or_zero, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) > 0 AS has_length
FROM conversations""")
def fit_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the conversations, publish, read back, embed the conversations: each with a word has
    a vector of length 1, and none of zeros."""
    root = scratch_path(spark, "registry")
    corpus = table(spark, sf, "conversations")
    training.publish_embedding(spark, root, "v1", corpus, dimensions=64)
    model = registry.load_embedding_model(spark, root, "v1")
    embedded = embedding.embed(corpus, model).withColumn("has_length", F.exists("embedding", lambda x: x != 0))
    return _shape(embedded, "conv_id", "turn", "has_length")


def _embedded_pending(spark: SparkSession, sf: str) -> DataFrame:
    model = embedding.fit_embedding(table(spark, sf, "conversations"), dimensions=64)
    stored = _embedded(spark, sf).withColumn("id", F.col("review_id")).select(
        "id", "organization_id", F.lit("p").alias("product_id"), "review_id", F.lit("m").alias("model_name"),
        "model_version", "embedding", F.timestamp_seconds(F.lit(EPOCH_2024)).alias("created_at"),
    )
    run = scoring.embed_pending(
        clean_reviews(spark, sf), stored, embedding.embedder(model), "v1", F.timestamp_seconds(F.lit(EPOCH_2024))
    )
    return run.embedded_rows


@register("SELECT doc_id AS review_id, 64 AS width, true AS unit_or_zero FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Embed the labelled reviews that have no vector yet, with a model fitted on conversations."""
    return _shape(_embedded_pending(spark, sf), "review_id")


@register()
def embedded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors themselves of the reviews that had none."""
    return _embedded_pending(spark, sf).select("review_id", "model_version", "embedding")


def _semantic_hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Fit on the reviews of one product, embed them, search them by text; hits and what is exact."""
    clean = clean_reviews(spark, sf)
    corpus = corpora.read_corpus_from_reviews(clean, "en", "src2")
    embedder = embedding.embedder(embedding.fit_embedding(corpus, dimensions=64))
    mine = clean.where("organization_id = 'en' AND product_id = 'src2'")
    stored = scoring.embed_reviews(mine, embedder, "v1", F.timestamp_seconds(F.lit(EPOCH_2024)))
    stored = cut_lineage(stored, "embedded")
    asked = "and the of that this"
    found = searching.semantic_search(stored, clean, embedder, asked, "v1", "en", "src2")
    vector = embedder(spark.createDataFrame([(asked,)], "text_normalized string")).first()["embedding"]
    similarity = vectors.cosine_similarity(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(x)) for x in vector]))
    return found, stored.select("review_id", similarity.alias("s")).orderBy(F.desc("s"), "review_id").limit(10)


@register()
def semantic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The reviews that a search by text finds, with their similarity."""
    found, _ = _semantic_hits(spark, sf)
    return found.select("review_id", "text_redacted", "language", "rating", "occurred_at", F.round("similarity", 6).alias("similarity"))


@register("""SELECT least(10, count(*)) AS hits, true AS recall_reached FROM documents WHERE lang = 'en' AND source = 'src2'""")
def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """How many reviews a search by text finds, and whether they are the nearest ones."""
    found, exact = _semantic_hits(spark, sf)
    return _recall(found, exact, exact.count(), 0.9)


# ---------------------------------------------------------------- identifiers, constraints, jobs


@register("SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def uuid7_millis(spark: SparkSession, sf: str) -> DataFrame:
    """Ids made for the event times give the times back."""
    stamp = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z")))
    made = table(spark, sf, "events").select("event_id", ids.uuid7(F.unix_millis(stamp), F.col("event_id")).alias("u"))
    return made.select("event_id", ids.uuid7_millis("u").alias("millis"))


@register("SELECT count(*) AS ids, count(*) AS distinct_ids, true AS well_formed FROM events")
def uuid7_column(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "events").select(ids.uuid7(F.lit(EPOCH_2024 * 1000), F.col("event_id")).alias("u"))
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return made.agg(
        F.count(F.lit(1)).alias("ids"), F.count_distinct("u").alias("distinct_ids"),
        F.bool_and(F.col("u").rlike(shape)).alias("well_formed"),
    )


@register(f"""WITH {REVIEWS_SQL} SELECT source_id, external_id, count(*) AS rows FROM reviews WHERE source_id IS NOT NULL AND external_id IS NOT NULL
GROUP BY ALL HAVING count(*) > 1""")
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.check_unique(reviews_of(spark, sf), ("source_id", "external_id"))


@register("""SELECT c_custkey AS id FROM customer WHERE NOT EXISTS
(SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = c_custkey % 6)""")
def check_foreign_key(spark: SparkSession, sf: str) -> DataFrame:
    child = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("product_id"),
        (F.col("c_custkey") % 6).alias("organization_id"),
    )
    keys = ("product_id", "organization_id")
    return integrity.check_foreign_key(child, products_of(spark, sf), keys, ("id", "organization_id")).select("id")


@register("""SELECT event_id AS id, unnest(list_filter([
CASE WHEN event_type NOT IN ('pending', 'ready', 'rejected') THEN 'status: not in domain' END,
CASE WHEN event_type = 'view' THEN 'language: null' END,
CASE WHEN length(CASE event_type WHEN 'view' THEN NULL ELSE props || props END) > 16 THEN 'language: longer than 16' END,
CASE WHEN NOT floor(value) BETWEEN 1 AND 5 THEN 'rating: outside 1..5' END], lambda x: x IS NOT NULL)) AS violation FROM events""")
def check_domain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.floor("value").alias("rating"),
        F.when(F.col("event_type") != "view", F.concat("props", "props")).alias("language"),
    )
    return integrity.check_domain("reviews", rows)


def constrained(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Stand-ins for all tables with rules; some of their keys repeat, some point nowhere."""
    moment = F.timestamp_seconds(F.lit(EPOCH_2024))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    owner, product = F.col("n_regionkey").cast("long").alias("organization_id"), F.col("n_nationkey").cast("long").alias("product_id")
    orders = table(spark, sf, "orders")
    results = orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("review_id"), (F.col("o_custkey") % 6).alias("organization_id"),
        (F.col("o_custkey") % 25).alias("product_id"), F.col("o_orderstatus").alias("model_version"), F.lit("m").alias("model_name"),
    )
    return {
        "organizations": organizations_of(spark, sf),
        "users": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("auth_subject"), F.lit(True).alias("is_active"),
            F.concat("c_mktsegment", F.lit("@"), F.col("c_nationkey").cast("string")).alias("email"),
        ),
        "memberships": table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6).alias("organization_id"), (F.col("s_suppkey") % 45).alias("user_id"), F.lit("viewer").alias("role"),
        ),
        "products": products_of(spark, sf),
        "sources": sources_of(spark, sf),
        "reviews": customers.select(
            F.col("c_custkey").alias("id"), owner, product, (F.col("c_custkey") % 120).alias("source_id"),
            F.when(F.col("c_custkey") % 3 != 0, F.floor(F.col("c_custkey") / 4).cast("string")).alias("external_id"), moment.alias("occurred_at"),
        ),
        "review_sentiments": results,
        "review_embeddings": results.where("model_version = 'F'"),
    }


CONSTRAINED_SQL = f"""{OWNERS_SQL},
users AS (SELECT c_custkey AS id, c_name AS auth_subject, c_mktsegment || '@' || c_nationkey AS email FROM customer),
memberships AS (SELECT s_suppkey AS id, s_suppkey % 6 AS organization_id, s_suppkey % 45 AS user_id FROM supplier),
reviews AS (SELECT c_custkey AS id, n_regionkey AS organization_id, n_nationkey AS product_id, c_custkey % 120 AS source_id,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey // 4 AS VARCHAR) END AS external_id FROM customer JOIN nation ON n_nationkey = c_nationkey),
review_sentiments AS (SELECT o_orderkey AS id, o_custkey * 2 AS review_id, o_custkey % 6 AS organization_id, o_custkey % 25 AS product_id, o_orderstatus AS model_version FROM orders),
review_embeddings AS (SELECT * FROM review_sentiments WHERE model_version = 'F')"""

#: Every uniqueness rule and foreign key of the stand-ins, as SQL: table, columns (and parent, columns).
UNIQUE_RULES_SQL = (
    ("organizations", "lower(name)", "slug"), ("users", "auth_subject", "auth_subject"), ("users", "email", "email"),
    ("memberships", "organization_id || '|' || user_id", "organization_id,user_id"), ("products", "organization_id || '|' || lower(name)", "organization_id,key"),
    ("products", "id || '|' || organization_id", "id,organization_id"), ("sources", "id || '|' || product_id || '|' || organization_id", "id,product_id,organization_id"),
    ("sources", "product_id || '|csv|' || name", "product_id,source_type,external_reference"), ("reviews", "source_id || '|' || external_id", "source_id,external_id"),
    ("reviews", "id || '|' || organization_id", "id,organization_id"), ("review_sentiments", "review_id || '|' || model_version", "review_id,model_version"),
    ("review_embeddings", "review_id || '|' || model_version", "review_id,model_version"),
)
FOREIGN_RULES_SQL = (
    ("memberships", "organization_id", "organizations", "id"), ("memberships", "user_id", "users", "id"), ("products", "organization_id", "organizations", "id"),
    ("sources", "product_id,organization_id", "products", "id,organization_id"), ("reviews", "product_id,organization_id", "products", "id,organization_id"),
    ("reviews", "source_id,product_id,organization_id", "sources", "id,product_id,organization_id"),
    *[(t, "review_id,organization_id", "reviews", "id,organization_id") for t in ("review_sentiments", "review_embeddings")],
    *[(t, "product_id,organization_id", "products", "id,organization_id") for t in ("review_sentiments", "review_embeddings")],
)


@register(f"WITH {CONSTRAINED_SQL} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, count(*) AS rows FROM {t} WHERE {key} IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
    for t, key, rule in UNIQUE_RULES_SQL))
def unique_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All twelve uniqueness rules in one pass."""
    return integrity.unique_sweep(constrained(spark, sf)).withColumn("key", F.array_join("key", "|"))


@register(f"WITH {CONSTRAINED_SQL} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{keys}' AS rule, CAST(c.id AS VARCHAR) AS id FROM {t} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE "
    + " AND ".join(f"p.{a} = c.{b}" for a, b in zip(parent_keys.split(","), keys.split(","), strict=True)) + ")"
    for t, keys, parent, parent_keys in FOREIGN_RULES_SQL))
def foreign_key_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All foreign keys between the tables in one join."""
    return integrity.foreign_key_sweep(constrained(spark, sf)).select("table_name", "rule", "id")


@register(f"""WITH {OWNERS_SQL}
SELECT 'products' AS table_name, id FROM products WHERE organization_id <> 1
UNION ALL SELECT 'sources', s.id FROM sources s WHERE organization_id <> 1
UNION ALL SELECT 'organizations', id FROM organizations WHERE id <> 1
UNION ALL SELECT 'reviews', c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1
UNION ALL SELECT 'review_sentiments', o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1""")
def purge_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Remove one organization with all it owns; what is left of each table."""
    owned = {
        "organizations": organizations_of(spark, sf),
        "products": products_of(spark, sf),
        "sources": sources_of(spark, sf),
        "reviews": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("product_id"), F.lit(-1).cast("long").alias("source_id")
        ),
        "review_sentiments": table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("review_id"), F.lit(-1).cast("long").alias("product_id")
        ),
    }
    left = integrity.purge_cascade(owned, "organizations", spark.range(1, 2))
    parts = [df.select(F.lit(name).alias("table_name"), "id") for name, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


NOW = datetime(1998, 8, 1)
STALE_SQL = f"""{JOBS_SQL},
stale AS (SELECT * FROM jobs WHERE (status = 'pending' AND (dispatched_at IS NULL OR dispatched_at < TIMESTAMP '1998-08-01' - INTERVAL 15 MINUTE))
          OR (status = 'processing' AND started_at < TIMESTAMP '1998-08-01' - INTERVAL 15 MINUTE))"""


def _now() -> Column:
    return F.lit("1998-08-01 00:00:00").cast("timestamp")


@register(f"WITH {STALE_SQL} SELECT id, status, attempts FROM stale ORDER BY created_at, id LIMIT 50")
def stale_import_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.stale_import_jobs(import_jobs_of(spark, sf), _now()).select("id", "status", "attempts")


@register(f"WITH {STALE_SQL} SELECT id, CASE WHEN attempts < 5 THEN 'retry' ELSE 'exhausted' END AS decision FROM stale")
def split_by_attempts(spark: SparkSession, sf: str) -> DataFrame:
    stale = jobs.stale_import_jobs(import_jobs_of(spark, sf), _now(), limit=None)
    return jobs.split_by_attempts(stale).select("id", "decision")


@register(f"""WITH {JOBS_SQL} SELECT id, status, attempts, total_rows, imported_count AS imported, duplicate_count AS duplicates,
rejected_count AS rejected, error FROM jobs""")
def import_job_report(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.import_job_report(import_jobs_of(spark, sf))


# ---------------------------------------------------------------- streams


def _streamed_reviews(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The landed documents, and one file per tenant that is not UTF-8, imported as a stream."""
    root = _landed(spark, sf)
    broken = table(spark, sf, "documents").select(F.col("lang").alias("organization_id")).distinct()
    broken = broken.select("organization_id", F.unhex(F.lit("7B22FF")).cast("string").alias("value"))
    broken.coalesce(1).write.mode("append").partitionBy("organization_id").text(f"{root}/imports")
    query = stream_import(
        spark, f"{root}/imports", "jsonl", f"{root}/reviews", f"{root}/summary", f"{root}/checkpoint",
        **_owner(), ingested_at=F.timestamp_seconds(F.lit(EPOCH_2024)), files_per_batch=16, name_pattern="*.{json,txt}",
        errors_path=f"{root}/errors",
    )
    query.awaitTermination()
    return root, f"{root}/reviews"


@register(f"""SELECT *, CAST(1 AS BIGINT) AS failed_files, 'file is not valid UTF-8' AS failure FROM ({FILES_SQL})""")
def stream_import_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The import job as a stream over several batches of landed files, with what failed."""
    root, _ = _streamed_reviews(spark, sf)
    summary = spark.read.parquet(f"{root}/summary")
    tenant = tables.landing_owner(F.col("path")).alias("organization_id")
    counts = summary.groupBy(tenant).agg(
        *[F.sum(c).alias(c) for c in ("total_rows", "imported", "duplicates", "rejected")],
        F.count_if(F.col("status") == "failed").alias("failed_files"),
    )
    failures = spark.read.parquet(f"{root}/errors").where("row_number = 0").select(tenant, F.col("reason").alias("failure"))
    return counts.join(failures, "organization_id", "left")


@register(f"""WITH {CLEAN_SQL},
kept AS (SELECT DISTINCT organization_id, text_normalized AS t FROM clean WHERE length(text_redacted) >= 3),
scored AS (SELECT organization_id, CASE WHEN substr(t, 1, 1) < 'e' THEN 'negative' WHEN substr(t, 1, 1) < 'n' THEN 'neutral' ELSE 'positive' END AS label FROM kept)
SELECT organization_id, label, count(*) AS count FROM scored GROUP BY ALL""")
def stream_score_reviews(spark: SparkSession, sf: str) -> DataFrame:
    root, stored = _streamed_reviews(spark, sf)
    stream_score(
        spark, stored, f"{root}/sentiments", f"{root}/checkpoint-score", rule_analyzer, "v1",
        F.timestamp_seconds(F.lit(EPOCH_2024)), files_per_batch=64,
    ).awaitTermination()
    found = tables.read_table(spark, f"{root}/sentiments", REVIEW_SENTIMENTS)
    return found.groupBy("organization_id", "label").agg(F.count(F.lit(1)).alias("count"))


@register(f"""WITH {CLEAN_SQL} SELECT organization_id, 32 AS width, true AS unit_or_zero, count(DISTINCT content_hash) AS reviews
FROM clean WHERE length(text_redacted) >= 3 GROUP BY organization_id""")
def stream_embed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    root, stored = _streamed_reviews(spark, sf)
    model = embedding.fit_embedding(table(spark, sf, "conversations"), dimensions=32)
    stream_embed(
        spark, stored, f"{root}/embeddings", f"{root}/checkpoint-embed", embedding.embedder(model), "v1",
        F.timestamp_seconds(F.lit(EPOCH_2024)), files_per_batch=64,
    ).awaitTermination()
    shaped = _shape(spark.read.parquet(f"{root}/embeddings"), "review_id", "organization_id")
    return shaped.groupBy("organization_id", "width", "unit_or_zero").agg(F.count_distinct("review_id").alias("reviews"))
