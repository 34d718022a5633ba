"""The job store as tables: submission, event append with sequence numbers, artifacts, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_CHARS, DETAIL_CHARS = 4000, 1000  # fixed values: how much of an error is kept


def submitted(uploads: DataFrame, max_retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Jobs and their first events for (job_id, document_id, batch_id, created_at)."""
    jobs = uploads.select("job_id", "document_id", "batch_id", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.lit("queued").alias("current_stage"), F.lit(0).alias("attempt_count"), F.lit(max_retries).alias("max_retries"), "created_at")
    events = uploads.select("job_id", F.lit(1).cast("long").alias("sequence"), F.lit("queued").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("progress"), "created_at")
    return jobs, events


def appended(stored: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """``fresh`` events with the numbers that follow those stored for their job. Stored events are only aggregated."""
    last = stored.groupBy("job_id").agg(F.max("sequence").alias("_last"))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return fresh.withColumn("_n", number).join(last, "job_id", "left").withColumn("sequence", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


def failure(kind: Column, message: Column) -> Column:
    """struct(error_type, error_message, status, progress) of a job that failed."""
    return F.struct(F.substring(kind, 1, DETAIL_CHARS).alias("error_type"), F.substring(message, 1, MESSAGE_CHARS).alias("error_message"), F.lit("failed").alias("status"), F.lit(100).alias("progress"))


def attempt(jobs: DataFrame) -> DataFrame:
    """An attempt begins: counted, and the last error cleared."""
    return jobs.withColumns({"attempt_count": F.col("attempt_count") + 1, "error_type": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})


def replaced(artifacts: DataFrame, fresh: DataFrame, key: str = "job_id") -> DataFrame:
    """Artifacts of the jobs in ``fresh`` are replaced, all others kept."""
    kept = artifacts.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def monotonic_violations(events: DataFrame) -> DataFrame:
    """Events whose progress is below the one before in their job."""
    before = F.lag("progress").over(Window.partitionBy("job_id").orderBy("sequence"))
    return events.withColumn("_before", before).where("progress < _before").drop("_before")


def invalid(events: DataFrame) -> DataFrame:
    """Events that break a constraint of the model, with the name of the first broken one."""
    broken = F.when(F.col("sequence") < 1, "sequence").when(~F.col("progress").between(0, 100), "progress").when(F.col("job_id").isNull(), "job_id")
    return events.withColumn("broken", broken).where("broken is not null")
