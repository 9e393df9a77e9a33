"""Training-job records: latest status by job, with expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed

# --- fixed values: job states, in the order a job passes through them ------
STATES = ["QUEUED", "IN_PROGRESS", "SUCCESS", "FAILURE"]


def latest_status(job_events: DataFrame) -> DataFrame:
    """(job_id, status, created, updated, n_events) from (job_id, status, at, event_id)."""
    return job_events.groupBy("job_id").agg(
        F.max_by("status", F.struct("at", "event_id")).alias("status"),
        F.min("at").alias("created"),
        F.max("at").alias("updated"),
        F.count(F.lit(1)).alias("n_events"),
    )


def unexpired(jobs: DataFrame, now, days: int = fixed.JOB_TTL_DAYS) -> DataFrame:
    """Jobs are forgotten ``days`` after they were created."""
    return jobs.filter(F.col("created") + F.make_dt_interval(days=F.lit(days)) > now)


def look_up(requested: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested ids with their status; ids without a record are 'not found'."""
    found = requested.join(jobs, "job_id", "left")
    return found.withColumn("status", F.coalesce("status", F.lit("not found")))
