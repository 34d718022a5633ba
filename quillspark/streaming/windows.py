"""Event-time windows and job state over streams; the same transforms serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], value: str) -> DataFrame:
    return _counted(events, F.window(F.col(time).cast("timestamp"), size), keys, value)


def sliding(events: DataFrame, time: str, size: str, slide: str, keys: list[str], value: str) -> DataFrame:
    return _counted(events, F.window(F.col(time).cast("timestamp"), size, slide), keys, value)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str) -> DataFrame:
    return _counted(events, F.session_window(F.col(time).cast("timestamp"), gap), keys, value)


def _counted(events: DataFrame, window, keys: list[str], value: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("begin"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "total")


def stream(spark: SparkSession, path: str, schema, time: str, late: str) -> DataFrame:
    """Parquet files as they arrive, with a watermark on ``time``."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there and read the result, which each micro-batch writes to files: in complete mode whole, else as an addition."""
    spark = df.sparkSession
    path, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark: what at-least-once delivery needs."""
    return events.dropDuplicatesWithinWatermark(keys)


def write_idempotent(df: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """A sink that a replayed micro-batch doesn't change: one folder a batch, overwritten as a whole."""

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
