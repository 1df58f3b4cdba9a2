"""Queries over the import job audit table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.relational import tenant_scope
from reviewmill.schemas import MAX_ATTEMPTS, STALE_AFTER_MINUTES, STALE_JOB_LIMIT


def stale_import_jobs(
    jobs: DataFrame,
    now: Column | datetime,
    stale_after_minutes: int = STALE_AFTER_MINUTES,
    limit: int | None = STALE_JOB_LIMIT,
    organization_id: object | None = None,
) -> DataFrame:
    """Jobs that were never (or too long ago) dispatched, or started too long ago and never
    ended; oldest first."""
    moment = now if isinstance(now, Column) else F.lit(now)
    cutoff = moment - F.make_dt_interval(mins=F.lit(stale_after_minutes))
    waiting = (F.col("status") == "pending") & (
        F.col("dispatched_at").isNull() | (F.col("dispatched_at") < cutoff)
    )
    stuck = (F.col("status") == "processing") & (F.col("started_at") < cutoff)
    found = jobs.where(waiting | stuck)
    if organization_id is not None:
        found = tenant_scope(found, organization_id)
    return found if limit is None else found.orderBy("created_at", "id").limit(limit)


def split_by_attempts(jobs: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Add ``decision``: ``retry`` while attempts are left, else ``exhausted``."""
    return jobs.withColumn(
        "decision", F.when(F.col("attempts") < max_attempts, "retry").otherwise("exhausted")
    )


def import_job_report(jobs: DataFrame) -> DataFrame:
    """What a user sees of a job."""
    return jobs.select(
        "id",
        "status",
        "attempts",
        "total_rows",
        F.col("imported_count").alias("imported"),
        F.col("duplicate_count").alias("duplicates"),
        F.col("rejected_count").alias("rejected"),
        "error",
    )
