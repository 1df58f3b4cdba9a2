"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "reviewmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume: UTC, AQE, skew-join handling."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would lose data with its executor, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reviewmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path in the shared folder."""
    return f"{shared_dir(spark)}/reviewmill/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written Parquet table survives lost executors, ends the lineage of iterative jobs,
    is read column by column, and gives the planner true sizes for join selection. What was shuffled
    for it goes with the write instead of whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    with shuffles_removed(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote, when nothing is going to read it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run meanwhile are removed at the end of each."""
    before = spark.conf.get(SHUFFLES_REMOVED, "false")
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_REMOVED, before)


def spread(df: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """Give every core a share of an input that arrives in fewer pieces than there are cores
    (one small file, one row group). Larger inputs pass through without a shuffle.

    With ``piece_rows``, for rows that take far longer to work on than to read, there is a piece for
    so many rows, so that a task's share does not grow with the input.
    """
    pieces = df.sparkSession.sparkContext.defaultParallelism
    if piece_rows:
        pieces = max(pieces, -(-df.count() // piece_rows))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def free_memory() -> None:
    """Hand memory of this process that is no longer in use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
