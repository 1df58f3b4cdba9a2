"""Streams over the landing folder and the stored reviews.

Each micro-batch runs the batch job and stores its result under the batch number, replacing
whatever an earlier attempt of the same batch left there. A batch that is replayed after a
failure therefore counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewmill.operators.dedup import EXTERNAL_KEYS, HASH_KEYS
from reviewmill.operators.incremental import pending_reviews
from reviewmill.operators.joins import settled
from reviewmill.operators.keyindex import KeyIndex, StoredKeys
from reviewmill.operators.language import LanguageModel
from reviewmill.plans.importing import import_reviews
from reviewmill.plans.scoring import Scorer, embed_reviews, score_reviews
from reviewmill.schemas import REVIEW_EMBEDDINGS, REVIEW_SENTIMENTS, REVIEWS
from reviewmill.sources.tables import PARTITIONS, overwrite_batch, read_table

FILES_PER_BATCH = 1000
KEY_BUCKETS = 64
_BATCH = "batch_id bigint"

COMPLETED, FAILED = "completed", "failed"
NOT_UTF8 = "file is not valid UTF-8"


def _earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The stored rows of earlier batches: what a replay of this batch has to see."""
    return read_table(spark, path, f"{schema}, {_BATCH}").where(F.col("batch_id") < batch_id).drop("batch_id")


def _overwrite(df: DataFrame, path: str, batch_id: int) -> None:
    """Store what one batch reports; writing the same batch again replaces it."""
    tagged = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    tagged.write.partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_keys(spark: SparkSession, reviews_path: str, keys_path: str, buckets: int = KEY_BUCKETS) -> StoredKeys:
    """The key indexes of a reviews table. Where there are none yet, they take in the table once."""
    kinds = (("hashes", HASH_KEYS), ("external-ids", EXTERNAL_KEYS))
    keys = StoredKeys(tuple(KeyIndex.open(spark, f"{keys_path}/{name}", columns, buckets) for name, columns in kinds))
    if all(index.stored().isEmpty() for index in keys.indexes):
        earlier = read_table(spark, reviews_path, f"{REVIEWS}, {_BATCH}")
        for (number,) in earlier.select(F.coalesce("batch_id", F.lit(-1))).distinct().collect():  # batches, not rows
            keys.add(earlier.where(F.coalesce("batch_id", F.lit(-1)) == number), number)
    return keys


def stream_import(
    spark: SparkSession,
    landing: str,
    source_format: str,
    reviews_path: str,
    summary_path: str,
    checkpoint: str,
    *,
    organization_id: Column,
    product_id: Column,
    source_id: Column,
    ingested_at: Column,
    model: LanguageModel | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    name_pattern: str | None = None,
    errors_path: str | None = None,
    keys_path: str | None = None,
    key_buckets: int = KEY_BUCKETS,
) -> StreamingQuery:
    """Import files as they land. The stream carries file paths only (never their bytes);
    the owner columns are expressions over ``path``.

    What is stored is known by key indexes at ``keys_path`` (``<reviews_path>-keys`` if not given). A
    batch looks its own keys up there and adds those it imported; it neither reads the stored
    reviews nor writes their keys anew. A replayed batch sees earlier batches only, so it comes
    to the same result, whether its keys had been added or not.
    """
    keys = stored_keys(spark, reviews_path, keys_path or f"{reviews_path.rstrip('/')}-keys", key_buckets)
    return _import_files(
        spark, landing, source_format, reviews_path, summary_path, checkpoint, keys, organization_id, product_id, source_id,
        ingested_at, model, files_per_batch, name_pattern, errors_path,
    )


def _import_files(
    spark: SparkSession,
    landing: str,
    source_format: str,
    reviews_path: str,
    summary_path: str,
    checkpoint: str,
    keys: StoredKeys,
    organization_id: Column,
    product_id: Column,
    source_id: Column,
    ingested_at: Column,
    model: LanguageModel | None,
    files_per_batch: int,
    name_pattern: str | None,
    errors_path: str | None,
) -> StreamingQuery:
    """The stream of ``stream_import``.

    A file that fails as a whole has a summary row with status ``failed`` and no counts. With
    ``errors_path`` the rejected rows are stored there, and failed files with row number 0.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", name_pattern or f"*.{source_format}")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(landing)
        .select("path")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.collect()]
        if not paths:
            return
        result = import_reviews(
            batch.sparkSession,
            paths,
            source_format,
            organization_id=organization_id,
            product_id=product_id,
            source_id=source_id,
            ingested_at=ingested_at,
            stored=keys.until(batch_id),
            model=model,
        )
        overwrite_batch(result.reviews, reviews_path, batch_id)
        keys.add(result.reviews, batch_id)
        failed = result.failed_files.select("path", *[F.lit(0).cast("long").alias(c) for c in result.summary.columns[1:]])
        summary = result.summary.withColumn("status", F.lit(COMPLETED)).unionByName(failed.withColumn("status", F.lit(FAILED)))
        _overwrite(summary, summary_path, batch_id)
        if errors_path is not None:
            whole = result.failed_files.select("path", F.lit(0).cast("long").alias("row_number"), F.lit(NOT_UTF8).alias("reason"))
            _overwrite(result.errors.unionByName(whole), errors_path, batch_id)

    return _start(files, each, checkpoint)


def _stream_results(
    spark: SparkSession,
    reviews_path: str,
    results_path: str,
    schema: str,
    checkpoint: str,
    version: str,
    rows_of: Callable[[DataFrame], DataFrame],
    files_per_batch: int,
) -> StreamingQuery:
    reviews = (
        spark.readStream.schema(f"{REVIEWS}, {_BATCH}")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .parquet(reviews_path)
        .drop("batch_id")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        # only results of this version, in the partitions of the batch's tenants and products
        done = _earlier(batch.sparkSession, results_path, schema, batch_id).where(F.col("model_version") == version)
        met, small = settled(batch.select(*PARTITIONS).distinct())
        if met.where(F.col(PARTITIONS[0]).isNull() | F.col(PARTITIONS[1]).isNull()).isEmpty():
            done = done.join(F.broadcast(met) if small else met, list(PARTITIONS), "left_semi").select(*done.columns)
        overwrite_batch(rows_of(pending_reviews(batch, done, version)), results_path, batch_id)

    return _start(reviews, each, checkpoint)


def stream_score(
    spark: SparkSession,
    reviews_path: str,
    sentiments_path: str,
    checkpoint: str,
    analyzer: Scorer,
    version: str,
    created_at: Column,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Score reviews as they are stored."""
    return _stream_results(
        spark, reviews_path, sentiments_path, REVIEW_SENTIMENTS, checkpoint, version,
        lambda todo: score_reviews(todo, analyzer, version, created_at), files_per_batch,
    )


def stream_embed(
    spark: SparkSession,
    reviews_path: str,
    embeddings_path: str,
    checkpoint: str,
    embedder: Scorer,
    version: str,
    created_at: Column,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Embed reviews as they are stored."""
    return _stream_results(
        spark, reviews_path, embeddings_path, REVIEW_EMBEDDINGS, checkpoint, version,
        lambda todo: embed_reviews(todo, embedder, version, created_at), files_per_batch,
    )
