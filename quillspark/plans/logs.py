"""Job state and operations from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import jobs, scans, summaries
from .registry import query, table

#: Event types stand for the statuses of jobs here; a user stands for a job or a batch.
_STATUS = {"signup": "queued", "view": "preprocessing", "click": "extracting", "purchase": "completed", "error": "failed"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])[F.col("event_type")]
    log = events.select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"), F.col("event_type").alias("stage"), F.col("value").cast("int").alias("progress"), F.col("ts").cast("timestamp").alias("created_at"))
    return jobs.sequenced(log, "job_id", "created_at", "event_id")


_STATE = f"""SELECT user_id AS job_id, arg_max(s, q) AS status, arg_max(event_type, q) AS stage, CAST(greatest(0, least(100, CAST(trunc(arg_max(value, q)) AS INTEGER))) AS INTEGER) AS progress,
    min(ts) FILTER (s IN ('preprocessing', 'extracting')) AS started_at, max(ts) FILTER (s IN ('completed', 'failed')) AS completed_at, count(*) AS events
    FROM (SELECT *, {_STATUS_SQL} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events) GROUP BY 1"""


@query(_STATE)
def st03_job_state(spark: SparkSession, sf: str) -> DataFrame:
    state = jobs.job_state(_log(spark, sf))
    return state.select("job_id", "status", "stage", "progress", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), F.col("events").cast("long").alias("events"))


@query("SELECT user_id, count(*) + 1 AS next_sequence FROM events GROUP BY 1")
def a18_next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).groupBy(F.col("job_id").alias("user_id")).agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).cast("long").alias("next_sequence"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'error')) AS done, round_even(100.0 * count(*) FILTER (event_type IN ('purchase', 'error')) / count(*)::DOUBLE, 2) AS progress FROM events GROUP BY 1")
def a21_batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.batch_progress(_log(spark, sf).withColumnRenamed("job_id", "user_id"), "user_id", "status")


@query(f"""SELECT count(*) AS job_count, count(*) FILTER (ended) AS terminal_job_count, round_even(count(*) FILTER (status = 'completed') / greatest(1, count(*) FILTER (ended))::DOUBLE, 6) AS success_rate,
    round_even(count(*) FILTER (status = 'failed') / greatest(1, count(*) FILTER (ended))::DOUBLE, 6) AS failure_rate, CAST(0 AS DOUBLE) AS needs_review_rate, round(coalesce(avg(s), 0), 3) AS mean_seconds, round(coalesce(quantile_cont(s, 0.5), 0), 3) AS p50_seconds, round(coalesce(quantile_cont(s, 0.95), 0), 3) AS p95_seconds, round(coalesce(max(s), 0), 3) AS max_seconds,
    max(completed_at) FILTER (ended) AS latest_terminal_at FROM (SELECT *, CASE WHEN ended AND completed_at >= started_at THEN epoch(completed_at) - epoch(started_at) END AS s
    FROM (SELECT *, status IN ('completed', 'failed') AS ended FROM ({_STATE})))""")
def a22_ops_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.operations(jobs.job_state(_log(spark, sf)))
    seconds = ["mean_seconds", "p50_seconds", "p95_seconds", "max_seconds"]
    return out.withColumns({c: F.round(c, 3) for c in seconds} | {"latest_terminal_at": F.col("latest_terminal_at").cast("timestamp_ntz")})


@query("SELECT event_type, CAST(le AS DOUBLE) AS le, count(e.value) FILTER (e.value <= le) AS n FROM events e CROSS JOIN (VALUES (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (2.5), (5.0), (15.0), (30.0)) b(le) GROUP BY 1, 2")
def a38_latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.latency_buckets(table(spark, sf, "events"), ["event_type"], "value", patterns.LATENCY_BUCKETS)


@query("SELECT status, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{s}')" for s in patterns.JOB_STATUSES) + f") v(status) LEFT JOIN (SELECT {_STATUS_SQL} AS status, count(*) AS n FROM events GROUP BY 1) USING (status)")
def a39_zero_filled_status(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(s,) for s in patterns.JOB_STATUSES], "status string")
    counts = _log(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type, round(coalesce(avg(value) FILTER (value >= 10), 0), 6) AS mean_conf FROM events GROUP BY 1")
def a40_mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg(F.when(v >= 10, v)), F.lit(0.0)), 6).alias("mean_conf"))


_STAGES = [*jobs.STAGE_STATUS, "rendering"]  # the last one has no status of its own


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'classifying' WHEN 3 THEN 'extracting' WHEN 4 THEN 'redacting'
    WHEN 5 THEN 'persisting' WHEN 6 THEN 'completed' WHEN 7 THEN 'needs_review' ELSE 'extracting' END AS status FROM events""")
def st02_stage_status(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (F.col("event_id") % 9).cast("int") + 1)
    return table(spark, sf, "events").select("event_id", jobs.status_of(stage).alias("status"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, count(*) FILTER (event_type = 'error') <= 2 AND arg_max(event_type, epoch_us(ts) * 1000 + event_id % 1000) = 'error' AS may_retry, least(60, 10 * (count(*) FILTER (event_type = 'error') + 1)) AS retry_delay FROM events GROUP BY 1")
def st06_retry(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max_by("event_type", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000)
    state = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"), F.when(last == "error", "failed").otherwise("completed").alias("status"))
    return jobs.retryable(state.withColumn("max_retries", F.lit(2))).select("user_id", "attempts", "may_retry", F.col("retry_delay").cast("long").alias("retry_delay"))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY 1")
def st10_ordered_read(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return scans.joined_text(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), ">", "path")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def snk05_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("ts"))
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    order = F.struct("ts", "event_id")
    both = old.unionByName(new).withColumn("at", order)
    return jobs.upsert(both.where("event_id % 2 = 0"), both.where("event_id % 2 = 1"), "user_id", "at").select("user_id", "event_id")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def w14_daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))

