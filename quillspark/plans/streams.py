"""Windows over the event log, in batch (checked by SQL) and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from ..streaming import windows
from .registry import query, table


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS begin, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def st_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(table(spark, sf, "events"), "ts", "1 day", ["event_type"], "value")


@query("""SELECT event_type, b AS begin, b + INTERVAL 12 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS b FROM events) GROUP BY 1, 2, 3""")
def st_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding(table(spark, sf, "events"), "ts", "12 hours", "6 hours", ["event_type"], "value")


@query("""WITH g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS b FROM events))
    SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def st_session(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events"), "ts", "8 hours", ["user_id"], "value")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    folder = sf.rstrip("/")
    # the table is one file at small sizes and a folder of files at larger ones; a stream reads folders
    one_file = events.inputFiles()[0].endswith("/events.parquet")
    reader = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet" if one_file else "*.parquet")
    events = reader.parquet(folder if one_file else f"{folder}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS begin, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def st_tumbling_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stream in complete mode says what the batch says."""
    return windows.drained(windows.tumbling(_stream(spark, sf), "ts", "1 day", ["event_type"], "value"), "tumbling", "complete")


@query("""SELECT user_id AS job_id, arg_max(CASE event_type WHEN 'view' THEN 'preprocessing' ELSE 'extracting' END, event_id) AS status, arg_max(event_type, event_id) AS stage, 50 AS progress,
    min(ts) AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at, max(event_id) AS events FROM events GROUP BY 1""")
def st_job_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Job state as a streaming aggregation, updated as events arrive."""
    events = _stream(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "view", "preprocessing").otherwise(jobs.status_of(F.col("event_type"))).alias("status"), F.col("event_type").alias("stage"), F.lit(50).alias("progress"), F.col("ts").alias("created_at"))
    state = windows.drained(jobs.job_state(events), "state", "complete")
    return state.select("job_id", "status", "stage", "progress", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), F.col("events").cast("long").alias("events"))


@query("SELECT DISTINCT event_id, event_type FROM events")
def st_dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = windows.deduplicated(_stream(spark, sf), ["event_id"])
    return windows.drained(events.select("event_id", "event_type"), "dedup", "append")
