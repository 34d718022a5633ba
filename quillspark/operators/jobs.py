"""Job state, batches and operations from an append-only event log. Batch and streaming share these aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.numbers import elapsed_seconds, rate
from .percentiles import percentiles

#: Status that a stage stands for; others are ``extracting``.
STAGE_STATUS = {"uploaded": "queued", "preprocessing": "preprocessing", "classifying": "classifying", "extracting": "extracting", "redacting": "redacting", "persisting": "persisting", "completed": "completed", "needs_review": "needs_review"}


def sequenced(events: DataFrame, job: str, time: str, tie: str) -> DataFrame:
    """Number the events of each job from 1."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(job).orderBy(time, tie)))


def status_of(stage):
    out = F.lit("extracting")
    for name, status in STAGE_STATUS.items():
        out = F.when(stage == name, F.lit(status)).otherwise(out)
    return out


def job_state(events: DataFrame) -> DataFrame:
    """One row a job from (job_id, sequence, status, stage, progress, created_at): a single aggregation.

    ``started_at`` is the first event of an active status or the first start of an attempt, and stays
    over attempts; ``completed_at`` is the latest terminal event. Without a start there is no time.
    """
    terminal = F.col("status").isin(patterns.TERMINAL)
    last = F.max_by(F.struct("status", "stage", F.greatest(F.lit(0), F.least(F.lit(100), "progress")).alias("progress")), "sequence")
    state = events.groupBy("job_id").agg(
        last.alias("s"),
        F.min(F.when(F.col("status").isin(patterns.ACTIVE) | (F.col("stage") == "attempt"), F.col("created_at"))).alias("started_at"),
        F.max(F.when(terminal, F.col("created_at"))).alias("completed_at"),
        F.count_if(F.col("stage") == "attempt").alias("attempts"),
        F.max("sequence").alias("events"),
    )
    took = F.when(F.col("completed_at") >= F.col("started_at"), elapsed_seconds(F.col("started_at"), F.col("completed_at")))
    return state.select("job_id", "s.*", "started_at", "completed_at", took.alias("processing_seconds"), "attempts", "events")


def batch_progress(jobs: DataFrame, batch: str, status: str) -> DataFrame:
    """Per batch: jobs, done (failed ones too), per cent done to two places, half to even."""
    done = F.count_if(F.col(status).isin(patterns.TERMINAL))
    return jobs.groupBy(batch).agg(F.count("*").alias("total"), done.alias("done"), F.bround(100.0 * done / F.count("*"), 2).alias("progress"))


def operations(jobs: DataFrame) -> DataFrame:
    """One row: counts; rates, times and percentiles over terminal jobs; zeros where there are none."""
    ended = F.col("status").isin(patterns.TERMINAL)
    n = F.count_if(ended)
    success = F.count_if(F.col("status").isin(patterns.SUCCESS))
    seconds = F.when(ended, F.col("processing_seconds"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = jobs.agg(
        F.count("*").alias("job_count"),
        n.alias("terminal_job_count"),
        F.bround(rate(success, n), 6).alias("success_rate"),
        F.bround(rate(F.count_if(F.col("status") == "failed"), n), 6).alias("failure_rate"),
        F.bround(rate(F.count_if(F.col("status") == "needs_review"), n), 6).alias("needs_review_rate"),
        zero(F.avg(seconds)).alias("mean_seconds"),
        zero(F.max(seconds)).alias("max_seconds"),
        F.max(F.when(ended, F.col("completed_at"))).alias("latest_terminal_at"),
    )
    ranks = percentiles(jobs, [], seconds, {"p50": 0.5, "p95": 0.95})
    columns = [F.col(c) for c in one.columns]
    shares = [zero(F.col(c)).alias(f"{c}_seconds") for c in ("p50", "p95")]
    return one.join(ranks).select(*columns[:6], *shares, *columns[6:])  # one row each


def retryable(jobs: DataFrame) -> DataFrame:
    """Which jobs a manual retry may take, and the delay of the next automatic one."""
    fails = F.col("status") == "failed"
    spent = F.col("attempts") > F.col("max_retries")
    return jobs.withColumn("may_retry", fails & ~spent).withColumn("retry_delay", F.least(F.lit(60), 10 * (F.col("attempts") + 1)))


def upsert(stored: DataFrame, fresh: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key; an empty value of ``metadata`` doesn't replace an older one."""
    every = stored.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in every.columns if c != key]
    out = every.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("s"), *([F.max_by(F.when(~F.col("metadata").isin("", "{}"), F.col("metadata")), F.when(~F.col("metadata").isin("", "{}"), F.col(time))).alias("_m")] if "metadata" in rest else []))
    columns = [F.coalesce("_m", "s.metadata").alias("metadata") if c == "metadata" else F.col(f"s.{c}") for c in rest]
    return out.select(key, *columns)
