"""The status of each document's job, kept in state that outlives the driver: queued, running, done, failed or timed_out."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds from the begin of a job after which it counts as timed out.
TIMEOUT = 900
EVENT = "doc_id string, at timestamp, stage string, progress int, message string"
STATUS = "doc_id string, status string, progress int, message string, at timestamp"
#: A status is replaced by one of a higher rank, or by a later one of the same rank.
RANKS = {"queued": 0, "running": 1, "timed_out": 2, "failed": 3, "done": 3}
FIRST = datetime(1970, 1, 1, tzinfo=timezone.utc)


def millis(at: datetime) -> int:
    return round((at.astimezone(timezone.utc) - FIRST).total_seconds() * 1000)


class JobStatus(StatefulProcessor):
    """Takes events of a document in any order and gives its status whenever that changes.

    An end (done or failed) that lies after the deadline comes too late: the job stays timed out. Of two ends the earlier counts. A lost begin means that there is no
    deadline; a late one sets it anew.
    """

    def __init__(self, timeout: int = TIMEOUT):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, progress int, message string, at long, deadline long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else (None, None, None, None, None)
        status, progress, message, at, deadline = old
        for e in rows:
            when = millis(e.at)
            if e.stage == "running" and (deadline is None or when + 1000 * self.timeout < deadline):
                if deadline is not None:
                    self.handle.deleteTimer(deadline)
                deadline = when + 1000 * self.timeout
                self.handle.registerTimer(deadline)
            new = e.stage
            if deadline is not None and when > deadline:
                new, when = "timed_out", deadline
            rank, had = RANKS.get(new, 1), -1 if status is None else RANKS[status]
            # ends: the earlier one; else the later one
            if rank > had or (rank == had and (when < at if rank == 3 else when > at)):
                status, progress, message, at = (new if new in RANKS else "running"), e.progress, e.message, when
        if status in ("done", "failed", "timed_out") and deadline is not None:
            self.handle.deleteTimer(deadline)
        self.state.update((status, progress, message, at, deadline))
        if (status, progress, message, at) != tuple(old)[:4]:
            yield Row(doc_id=key[0], status=status, progress=progress, message=message, at=datetime.fromtimestamp(at / 1000, timezone.utc))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, progress, message, _, deadline = self.state.get()
        if RANKS[status] < RANKS["timed_out"]:
            self.state.update(("timed_out", progress, message, deadline, deadline))
            yield Row(doc_id=key[0], status="timed_out", progress=progress, message=message, at=datetime.fromtimestamp(deadline / 1000, timezone.utc))

    def close(self) -> None:
        pass


def job_status(events: DataFrame, timeout: int = TIMEOUT, late_by: str = "1 minute") -> DataFrame:
    """Changes of status of a stream of events (``EVENT``); rows without id, time or stage are left out. Time is that of the events: a job times out once all events have gone past its deadline."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = events.where("doc_id IS NOT NULL AND at IS NOT NULL AND stage IS NOT NULL").withWatermark("at", late_by)
    return known.groupBy("doc_id").transformWithState(JobStatus(timeout), STATUS, "Update", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The last status of each document among written changes."""
    rank = F.create_map(*(x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))))[F.col("status")]
    last = F.max_by(F.struct("status", "progress", "message", "at"), F.struct(rank, "batch", "at"))
    return changes.groupBy("doc_id").agg(last.alias("x")).select("doc_id", "x.*")


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, timeout: int = TIMEOUT, late_by: str = "1 minute"):
    """Read events that have arrived as JSON lines and append changes as ``out/batch=...``; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    events = spark.readStream.schema(EVENT).json(path)
    return job_status(events, timeout, late_by).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
