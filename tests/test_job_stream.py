"""The stateful stream of jobs against the batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.operators import jobs
from quillspark.sources.scratch import scratch
from quillspark.streaming import jobs as stream

SCHEMA = "job_id long, sequence long, status string, stage string, progress int, created_at timestamp"


def events(rng, job, n):
    at = datetime(2024, 1, 1) + timedelta(minutes=job)
    out = []
    for i in range(1, n + 1):
        at += timedelta(seconds=rng.randrange(1, 40))
        status = rng.choice(["queued", "preprocessing", "extracting", "redacting", "completed", "failed", "needs_review"])
        out.append((job, i, status, "attempt" if rng.random() < 0.2 else status, rng.randrange(-5, 120), at))
    return out


def test_several_batches_and_a_restart_give_the_batch_result(spark):
    rng = random.Random(4)
    rows = [e for job in range(12) for e in events(rng, job, rng.randrange(1, 9))]
    told = rows + rng.sample(rows, 15)  # some come twice
    rng.shuffle(told)
    folder, path, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "check")
    changes = stream.job_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), late="2 days")
    for part in range(3):  # each call is a new start from the checkpoint
        for half in range(2):
            spark.createDataFrame(told[2 * part + half :: 6], SCHEMA).coalesce(1).write.parquet(f"{folder}/{part}{half}")
        stream.run(changes, path, checkpoint)
    got = stream.latest(spark.read.parquet(path).drop("batch"))
    names = ["job_id", "status", "stage", "progress", "started_at", "completed_at", "attempts"]
    want = jobs.job_state(spark.createDataFrame(rows, SCHEMA)).select(*names, F.col("events").alias("sequence"))
    key = lambda r: tuple(r[c] for c in [*names, "sequence"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    waiting = {r["job_id"] for r in got.collect() if r["retry_at"] is not None}
    assert waiting == {r["job_id"] for r in want.collect() if r["status"] == "failed" and r["attempts"] <= 2}


def test_timers_retry_and_tell_what_is_overdue(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [
        [(1, 1, "extracting", "extracting", 10, at(0)), (1, 2, "failed", "failed", 100, at(1)), (2, 1, "extracting", "extracting", 10, at(0)), (3, 1, "extracting", "extracting", 5, at(0)), (3, 2, "completed", "completed", 100, at(1))],
        [(9, 1, "queued", "queued", 0, at(300))],
        [(9, 2, "queued", "queued", 0, at(301))],
    ]
    folder = scratch(spark, "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    changes = stream.job_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), deadline=600, late="1 minute")
    got = {r["job_id"]: r for r in stream.latest(stream.drained(changes)).collect()}
    assert got[1]["status"] == "retrying" and got[2]["was_overdue"] and got[2]["status"] == "extracting"
    assert got[3]["status"] == "completed" and not got[3]["was_overdue"] and got[9]["sequence"] == 2
