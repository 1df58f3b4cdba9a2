"""Stored tables: appending reviews, replacing snapshots, and the landing layout."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators.incremental import RESULT_KEYS, upsert
from reviewmill.operators.joins import settled
from reviewmill.schemas import IMPORT_FORMATS
from reviewmill.session import cut_lineage

PARTITIONS = ("organization_id", "product_id")


class MissingObject(FileNotFoundError):
    """A landing file that is not there (as opposed to one that cannot be read)."""


FILES_PER_PARTITION = 8


def _time_ordered_id() -> str:
    raw = bytearray((time.time_ns() // 1_000_000).to_bytes(6, "big") + os.urandom(10))
    raw[6] = 0x70 | raw[6] & 0x0F
    raw[8] = 0x80 | raw[8] & 0x3F
    return str(uuid.UUID(bytes=bytes(raw)))


def landing_path(root: str, organization_id: str, source_format: str) -> str:
    """A new, tenant-prefixed path for one uploaded file."""
    if source_format not in IMPORT_FORMATS:
        raise ValueError(f"unknown import format {source_format!r}")
    return f"{root.rstrip('/')}/imports/{organization_id}/{_time_ordered_id()}.{source_format}"


def landing_owner(path: Column) -> Column:
    """The tenant of a landed file, from its path."""
    return F.regexp_extract(path, r"/imports/(?:organization_id=)?([^/]+)/", 1)


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise ``MissingObject`` when a landing file does not exist."""
    try:
        spark.read.format("binaryFile").load(list(paths)).select("path").isEmpty()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise MissingObject(str(exc)) from exc
        raise


def _partitioned(rows: DataFrame) -> DataFrame:
    """Rows dealt by tenant, product and one of a few shares, so that a partition has few files
    and a tenant that owns a third of the rows is not written by one task."""
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(FILES_PER_PARTITION))
    return rows.repartition(*PARTITIONS, share)


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Add accepted reviews to the stored table, partitioned by tenant and product."""
    _partitioned(reviews).write.partitionBy(*PARTITIONS).mode("append").parquet(path)


def store_results(
    spark: SparkSession, path: str, schema: str, incoming: DataFrame, update: Sequence[str], keys: Sequence[str] = RESULT_KEYS
) -> None:
    """Merge ``incoming`` into the stored results at ``path``, as ``operators.incremental.upsert`` does,
    and rewrite only the partitions (tenant, product) that it meets.

    These are the partitions of the batch and those that hold one of its keys; they are found by
    key columns alone. The files of all others stay as they are. Tenant and product must be given.
    """
    incoming = cut_lineage(incoming, "results-batch")
    if not incoming.where(F.col(PARTITIONS[0]).isNull() | F.col(PARTITIONS[1]).isNull()).isEmpty():
        raise ValueError(f"results without {' or '.join(PARTITIONS)}")
    stored = read_table(spark, path, schema)
    asked, small = settled(incoming.select(*keys).distinct())
    held = stored.select(*keys, *PARTITIONS).join(F.broadcast(asked) if small else asked, list(keys), "left_semi")
    touched, few = settled(incoming.select(*PARTITIONS).unionByName(held.select(*PARTITIONS)).distinct())
    mine = stored.join(F.broadcast(touched) if few else touched, list(PARTITIONS), "left_semi").select(*stored.columns)
    merged = upsert(mine, incoming.select(*stored.columns), update, keys)
    writer = _partitioned(merged).write.partitionBy(*PARTITIONS).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)


def overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store the rows of one batch; writing the same batch again replaces it."""
    tagged = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    (
        tagged.write.partitionBy("batch_id", *PARTITIONS)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a whole new state of a table next to the old ones, which may still be read.

    The state is announced only once it is complete: a snapshot whose job died is never
    picked up.
    """
    name = f"snapshot={time.time_ns():020d}"
    target = f"{path.rstrip('/')}/{name}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    announced = df.sparkSession.createDataFrame([(name,)], "value string").coalesce(1)
    announced.write.mode("append").text(f"{path.rstrip('/')}/published")
    return target


def latest_snapshot(spark: SparkSession, path: str) -> str | None:
    """The newest announced snapshot directory."""
    try:
        newest = spark.read.text(f"{path.rstrip('/')}/published").agg(F.max("value").alias("name")).first()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return f"{path.rstrip('/')}/{newest.name}" if newest.name else None


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest finished state of a snapshot table; empty when there is none."""
    found = latest_snapshot(spark, path)
    return read_table(spark, found, schema) if found else spark.createDataFrame([], schema)
