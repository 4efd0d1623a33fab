"""Progress of streaming jobs, as rows that a monitor can poll."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the latest ``most`` events: ``(query id, stage, batch, rows, message)`` with stage started, running, finished or failed.

    Register with ``spark.streams.addListener``.
    """

    def __init__(self, most: int = 1000):
        self.events: deque[tuple[str, str, int | None, int | None, str]] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.events.append((str(event.id), "started", None, None, event.name or ""))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.events.append((str(p.id), "running", p.batchId, p.numInputRows, p.name or ""))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.events.append((str(event.id), "failed" if event.exception else "finished", None, None, event.exception or ""))
