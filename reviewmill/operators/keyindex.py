"""Keys of stored reviews, kept in buckets so that new rows meet them without moving them.

An index is a bucketed Parquet table beside the reviews: one row per key and batch, hashed into
a fixed number of buckets by exactly the columns that rows are compared by. Spark then joins
bucket by bucket: the keys of the new rows are dealt to the buckets, and what is stored is read
in place, without an exchange. A batch adds its own keys and rewrites nothing.

Files say themselves which bucket they hold, so any session can open an index by its path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def all_given(keys: Sequence[str]) -> Column:
    """Whether no column of the key is NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


@dataclass(frozen=True)
class KeyIndex:
    """The stored keys of one kind; ``before`` hides the keys of that batch and of later ones."""

    spark: SparkSession
    table: str
    keys: tuple[str, ...]
    buckets: int
    before: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> KeyIndex:
        """The index at ``path``, empty if nothing was ever added. Keys are string columns."""
        name = f"keys_{hashlib.md5(f'{path}|{buckets}|{keys}'.encode()).hexdigest()}"
        columns = ", ".join(f"`{k}` STRING" for k in keys)
        named = ", ".join(f"`{k}`" for k in keys)
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch_id BIGINT) USING parquet "
            f"PARTITIONED BY (batch_id) CLUSTERED BY ({named}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        spark.catalog.refreshTable(name)  # batches of other sessions
        return cls(spark, name, tuple(keys), buckets)

    def until(self, batch_id: int) -> KeyIndex:
        """What a batch has to see, also when it is replayed: the keys of earlier batches."""
        return KeyIndex(self.spark, self.table, self.keys, self.buckets, batch_id)

    def stored(self) -> DataFrame:
        rows = self.spark.table(self.table)
        return (rows if self.before is None else rows.where(F.col("batch_id") < self.before)).select(*self.keys)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The distinct complete keys of ``rows``, as buckets are dealt."""
        return rows.where(all_given(self.keys)).select(*self.keys).distinct().repartition(self.buckets, *self.keys)

    def known(self, rows: DataFrame) -> DataFrame:
        """The keys of ``rows`` that are stored. Copies collapse before they move; stored keys stay."""
        return self.dealt(rows).hint("merge").join(self.stored(), list(self.keys), "left_semi")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add the keys of ``rows``. Adding a batch again adds nothing that ``known`` would tell apart."""
        new = self.dealt(rows.select(*[F.col(k).cast("string").alias(k) for k in self.keys]))
        new.select(*self.keys, F.lit(batch_id).cast("long").alias("batch_id")).write.insertInto(self.table)


@dataclass(frozen=True)
class StoredKeys:
    """The indexes that an import is compared with: by content hash and by external id."""

    indexes: tuple[KeyIndex, ...]

    def of(self, keys: Sequence[str]) -> KeyIndex:
        return next(i for i in self.indexes if i.keys == tuple(keys))

    def until(self, batch_id: int) -> StoredKeys:
        return StoredKeys(tuple(i.until(batch_id) for i in self.indexes))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        for index in self.indexes:
            index.add(rows, batch_id)
