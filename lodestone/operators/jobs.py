"""Durable job queues as snapshots: leases, claims, idempotency and terminal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("queued", "running")


def reset_stale(jobs: DataFrame, as_of: str, minutes: int = 15) -> DataFrame:
    """Running jobs without a lease, or with one older than ``minutes``, are queued again."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    stale = (F.col("status") == "running") & (F.col("locked_at").isNull() | (F.col("locked_at").cast("timestamp") < limit))
    return jobs.withColumns({"status": F.when(stale, "queued").otherwise(F.col("status")), "was_stale": stale, "locked_at": F.when(~stale, F.col("locked_at"))})


def latest_submission(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The last live submission of each kind and input."""
    live = jobs.where(F.col("status").isin(*LIVE))
    return live.groupBy(*keys).agg(F.max_by(F.struct(*live.columns), "submission_sequence").alias("row")).select("row.*")


def first_by_key(jobs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Idempotent enqueue: of submissions with one key the first counts."""
    return jobs.groupBy(*keys).agg(F.min_by(F.struct(*jobs.columns), order).alias("row")).select("row.*")


def claim(jobs: DataFrame, limit: int = 3) -> DataFrame:
    """The oldest queued jobs."""
    return jobs.where("status = 'queued'").orderBy("submission_sequence").limit(limit)


def fenced(writes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Writes whose job is running under the token that they carry."""
    held = jobs.where("status = 'running'").select(F.col("id").alias("job_id"), "token")
    return writes.join(held, ["job_id", "token"], "left_semi")


def terminal_record(status: Column, **fields: Column) -> Column:
    """Action and non-null metadata of a finished job, as JSON."""
    action = F.when(status == "completed", "job.completed").when(status == "failed", "job.failed").otherwise("job.open")
    return F.to_json(F.struct(action.alias("action"), *[v.alias(k) for k, v in fields.items()]))


def status_changes(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Events whose value differs from the one before, or that have none before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(value)))
