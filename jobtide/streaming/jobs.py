"""Structured Streaming jobs: job status from events, request metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from jobtide.operators.records import MILESTONES, status_timeline
from jobtide.sources.tables import KeyedTable

STATUS = "job_id long, status string, changed_at timestamp, applied_at timestamp, interview_scheduled_at timestamp, final_result_at timestamp, changes long"
STATE = "status string, at long, applied_at long, interview_scheduled_at long, final_result_at long, changes long"
NAMES = tuple(MILESTONES)
#: Jobs without an event for so long (event time) leave the state store.
KEEP = 90 * 86_400_000


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _stamp(x: int | None) -> pd.Timestamp | None:
    return None if x is None else pd.Timestamp(x, unit="us")


def fold(batches: Iterator[pd.DataFrame], status: str | None, at: int, first: list[int | None], n: int) -> tuple:
    """State after more events of a job."""
    for batch in batches:
        for row in batch.sort_values(["changed_at", "id"]).itertuples(index=False):
            when = _micros(row.changed_at)
            n += 1
            if when >= at:
                status, at = row.new_status, when
            for k, name in enumerate(NAMES):
                if row.new_status in MILESTONES[name] and (first[k] is None or when < first[k]):
                    first[k] = when
    return (status, at, *first, n)


def shown(key: tuple, state: tuple) -> pd.DataFrame:
    status, at, *first, n = state
    return pd.DataFrame({"job_id": [key[0]], "status": [status], "changed_at": [_stamp(at)], **{name: [_stamp(x)] for name, x in zip(NAMES, first, strict=True)}, "changes": [n]})


def fold_status(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Newest status by (time, id), earliest time of each milestone: the same for events in any order."""
    if state.hasTimedOut:
        state.remove()
        return
    status, at, *first, n = state.get if state.exists else (None, -1, None, None, None, 0)
    new = fold(batches, status, at, first, n)
    state.update(new)
    state.setTimeoutTimestamp(max(new[1] // 1000, state.getCurrentWatermarkMs() + 1) + KEEP)
    yield shown(key, new)


def status_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Current status and milestones of each job from a stream of status events, each id once; later events than the watermark are dropped."""
    rows = events.withWatermark("changed_at", late).dropDuplicatesWithinWatermark(["id"])
    return rows.groupBy("job_id").applyInPandasWithState(fold_status, STATUS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


class StatusProcessor(StatefulProcessor):
    """The same fold as keyed state with timers of its own: a job without an event for ``KEEP`` leaves the store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, at, *first, n = self.state.get() if self.state.exists() else (None, -1, None, None, None, 0)
        state = fold(rows, status, at, first, n)
        self.state.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(state[1] // 1000, timerValues.getCurrentWatermarkInMs()) + KEEP)
        yield shown(key, state)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def status_states(events: DataFrame, late: str = "1 day") -> DataFrame:
    """``status_stream`` on the engine's state API with timers; the session needs the RocksDB state store."""
    rows = events.withWatermark("changed_at", late).dropDuplicatesWithinWatermark(["id"])
    return rows.groupBy("job_id").transformWithStateInPandas(StatusProcessor(), STATUS, "Update", "EventTime")


CURRENT = "job_id long, status string, last_id long, changed_at timestamp, applied_at timestamp, interview_scheduled_at timestamp, final_result_at timestamp, changes long"


def batch_status(events: DataFrame) -> DataFrame:
    """Newest status, earliest milestones and number of events of each job in some events."""
    last = F.max_by(F.struct("new_status", "changed_at", "id"), F.struct("changed_at", "id")).alias("x")
    first = [F.min(F.when(F.col("new_status").isin(*s), F.col("changed_at"))).alias(name) for name, s in MILESTONES.items()]
    rows = events.groupBy("job_id").agg(last, *first, F.count("*").alias("changes"))
    return rows.select("job_id", F.col("x.new_status").alias("status"), F.col("x.id").alias("last_id"), F.col("x.changed_at").alias("changed_at"), *MILESTONES, "changes")


def status_change(old, new) -> dict[str, Column]:
    """For ``KeyedTable.upsert``: a later event takes over, milestones only move back, counts add up; in any order of batches."""
    later = F.coalesce(F.struct(new["changed_at"], new["last_id"]) > F.struct(old["changed_at"], old["last_id"]), F.lit(True)) | old["changed_at"].isNull()
    out = {c: F.when(later, new[c]).otherwise(old[c]) for c in ("status", "last_id", "changed_at")}
    out |= {c: F.least(old[c], new[c]) for c in MILESTONES}  # nulls are skipped
    return out | {"changes": F.coalesce(old["changes"], F.lit(0)) + new["changes"]}


class StatusTables:
    """Two tables fed by one stream: the current status of each job, and the history of all changes.

    The number of a micro-batch is the version of what it writes: its history is one folder that a repeated batch writes
    over, and the status table takes a batch once. So a stream that was stopped at any point goes on from its checkpoint
    as if it had not been.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder = spark, folder
        self.current = KeyedTable(spark, f"{folder}/current", "job_id", CURRENT, buckets)

    def write(self, events: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: the events of a micro-batch are computed once for both tables."""
        at = f"{self.folder}/history/batch={batch}"
        events.select("id", "job_id", "new_status", "changed_at").write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema("id long, job_id long, new_status string, changed_at timestamp").parquet(at)
        self.current.upsert(batch_status(rows), batch, status_change)

    def start(self, events: DataFrame, late: str = "1 day", **trigger) -> StreamingQuery:
        """Feed both tables from a stream of status events, each id once, later ones than the watermark dropped (``dropped`` counts them)."""
        rows = events.withWatermark("changed_at", late).dropDuplicatesWithinWatermark(["id"])
        writer = rows.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/stream")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def history(self) -> DataFrame:
        """All changes, each with the status before it."""
        rows = self.spark.read.schema("id long, job_id long, new_status string, changed_at timestamp, batch int").parquet(f"{self.folder}/history")
        return status_timeline(rows.drop("batch"))


def dropped(query: StreamingQuery) -> int:
    """Rows that came later than the watermark, over the progress that the query still remembers."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def request_metrics(requests: DataFrame, width: str = "1 minute", late: str = "10 minutes", accuracy: int = 10_000) -> DataFrame:
    """Per tumbling window and path: requests, errors, mean and approximate 95th percentile of the seconds (its rank is off by 1 / ``accuracy`` at most)."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    out = rows.groupBy(F.window("ts", width), "path").agg(
        F.count("*").alias("requests"), F.count_if(F.col("code") >= 500).alias("errors"), F.avg("seconds").alias("mean_seconds"), F.percentile_approx("seconds", 0.95, accuracy).alias("p95_seconds")
    )
    return out.select(F.col("window.start").alias("start"), "path", "requests", "errors", "mean_seconds", "p95_seconds")


def write_request_metrics(requests: DataFrame, folder: str, width: str = "1 minute", late: str = "10 minutes", **trigger) -> StreamingQuery:
    """Finished windows appended to files: a window is written once, when the watermark has passed its end; rows that come later are dropped."""
    writer = request_metrics(requests, width, late).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/stream")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over the files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
