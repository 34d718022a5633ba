"""Job state as a stream of its own: events in any order and more than once, attempts, retries and deadlines by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import patterns
from ..sources.scratch import scratch

#: State of a job: the number of the last event applied, what it said, and what follows from all before.
_STATE = "sequence long, status string, stage string, progress int, started_at timestamp, completed_at timestamp, attempts int, due_ms long"
_EVENT = "status string, stage string, progress int, created_at timestamp"
OUTPUT = "job_id long, sequence long, status string, stage string, progress int, started_at timestamp, completed_at timestamp, attempts int, retry_at timestamp, overdue boolean"


class JobProcessor(StatefulProcessor):
    """Applies a job's events in order of their numbers, which begin at 1.

    An event that has been applied or is waiting is dropped when it comes again; one that comes early waits, as a row of a map
    state, for those before it. A failed job that has attempts left gets a timer for its retry, with a delay that grows with
    attempts; a job that isn't done ``deadline`` seconds after its start is told as overdue, once. A row is given for each
    job that a micro-batch changes, and for each timer that goes off.
    """

    def __init__(self, max_retries: int = 2, deadline: int = 3600):
        self.max_retries, self.deadline = max_retries, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)
        self.early = handle.getMapState("early", "sequence long", _EVENT)

    def _rows(self, key, state: tuple, retry_ms: int | None = None, overdue: bool = False) -> pd.DataFrame:
        retry = None if retry_ms is None else pd.Timestamp(retry_ms, unit="ms")
        return pd.DataFrame({"job_id": [key[0]], **{n: [v] for n, v in zip(("sequence", "status", "stage", "progress", "started_at", "completed_at", "attempts"), state)}, "retry_at": [retry], "overdue": [overdue]}).astype({"started_at": "datetime64[us]", "completed_at": "datetime64[us]", "retry_at": "datetime64[us]"})

    def _apply(self, state: tuple, event: tuple) -> tuple:
        sequence, _, _, _, started, completed, attempts, due = state
        status, stage, progress, at = event
        if status in patterns.ACTIVE or stage == "attempt":
            started = at if started is None else min(started, at)
        if status in patterns.TERMINAL:
            completed = at if completed is None else max(completed, at)
        return (sequence + 1, status, stage, max(0, min(100, progress)), started, completed, attempts + (stage == "attempt"), due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.job.get()) if self.job.exists() else (0, None, None, None, None, None, 0, None)
        before = state[0]
        for batch in rows:
            for n, status, stage, progress, at in zip(batch["sequence"], batch["status"], batch["stage"], batch["progress"], batch["created_at"]):
                if n > state[0] and not self.early.containsKey((int(n),)):
                    self.early.updateValue((int(n),), (status, stage, int(progress), at.to_pydatetime()))
        while self.early.containsKey((state[0] + 1,)):
            n = state[0] + 1
            state = self._apply(state, tuple(self.early.getValue((n,))))
            self.early.removeKey((n,))
        if state[0] == before:
            return
        due, retry = state[7], None
        if due is not None:
            self.handle.deleteTimer(due)
            due = None
        millis = lambda t: int(pd.Timestamp(t).timestamp() * 1000)
        if state[1] == "failed" and state[6] <= self.max_retries:
            due = retry = millis(state[5]) + 1000 * min(60, 10 * (state[6] + 1))
        elif state[1] not in patterns.TERMINAL and state[4] is not None:
            due = millis(state[4]) + 1000 * self.deadline
        if due is not None:
            self.handle.registerTimer(due)
        state = (*state[:7], due)
        self.job.update(state)
        yield self._rows(key, state, retry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.job.get())
        if state[7] is None or state[7] != expiredTimerInfo.getExpiryTimeInMs():
            return
        retry = state[1] == "failed"
        if retry:
            state = (state[0], "retrying", state[2], state[3], *state[4:7], None)
        else:
            state = (*state[:7], None)
        self.job.update(state)
        yield self._rows(key, state, overdue=not retry)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, max_retries: int = 2, deadline: int = 3600, late: str = "1 hour") -> DataFrame:
    """Changes of jobs for a stream of (job_id, sequence, status, stage, progress, created_at). Timers go by event time."""
    watched = events.select("job_id", "sequence", "status", "stage", "progress", "created_at").withWatermark("created_at", late)
    return watched.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobProcessor(max_retries, deadline), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def run(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Take all that is there; each micro-batch is a folder of its own, so one that runs again replaces its rows. A later call goes on."""
    spark = changes.sparkSession
    provider, name = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        changes.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drained(changes: DataFrame) -> DataFrame:
    """All changes of a stream over what is there."""
    path = scratch(changes.sparkSession, "changes")
    run(changes, path, scratch(changes.sparkSession, "changes-checkpoint"))
    return changes.sparkSession.read.schema(changes.schema).parquet(path).select(*changes.columns)


def latest(changes: DataFrame) -> DataFrame:
    """The state of each job after all changes: those by the last event, timers' after it."""
    from pyspark.sql import functions as F

    rest = [c for c in changes.columns if c != "job_id"]
    told = F.struct("sequence", (F.col("status") == "retrying").cast("int"))
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*rest), told).alias("s"), F.max("overdue").alias("was_overdue")).select("job_id", "s.*", "was_overdue").drop("overdue")
