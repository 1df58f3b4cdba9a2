"""From raw documents to packed training sequences, stage by stage.

Each stage works on all documents that the one before kept, and is written as Parquet between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.llm import mixing, ngram_join, packing, secrets, toxicity
from reviewmill.session import cut_lineage, scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END, CAPACITY = 2, 4096
WEIGHTS, ROUNDS = (5, 2, 1), 3

#: The learned stages cannot be said in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from ``labels``, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, machine, "_toxic_score")
    return scored.where("_toxic_score < 0.5").drop("_toxic_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five words are similar."""
    return ngram_join.first_of_groups(docs, n=5, percent=75)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture uses it: not at all, once, or up to three times.

    The mixture is decided on ids and sizes; texts join it once. Rows equal in every column are
    one key, which comes as often as its rows are used together.
    """
    hashes = [F.xxhash64(*docs.columns).alias("_k1"), F.xxhash64(F.lit(1), *docs.columns).alias("_k2")]
    sized = docs.select("doc_id", mixing.word_count(F.col("text")).alias("size"), "source", *hashes)
    used, _ = mixing.mix_by_source(cut_lineage(sized, "sizes"), "source", WEIGHTS, ROUNDS)
    times = used.groupBy(F.col("_k1").alias("_u1"), F.col("_k2").alias("_u2")).agg(F.sum("rounds").alias("_times")).where("_times > 0")
    keyed = docs.select("*", *hashes).join(times, (F.col("_k1") == F.col("_u1")) & (F.col("_k2") == F.col("_u2")))
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))
    once = keyed.withColumn("_nth", nth).where("_nth = 1")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy")
    return once.select(*docs.columns, copies).drop("_copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed into sequences of CAPACITY tokens."""
    return packing.pack_documents(docs, TOKENIZER, END, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
