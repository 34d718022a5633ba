"""Progress of streams as rows: what a callback gets elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class ProgressRows(StreamingQueryListener):
    """Calls ``emit(stage, name, batch, rows)`` as a query starts, progresses and ends."""

    def __init__(self, emit: Callable[[str, str, int, int], None]):
        self.emit = emit
        self.names: dict = {}

    def onQueryStarted(self, event) -> None:
        self.names[event.id] = event.name or str(event.id)
        self.emit("started", self.names[event.id], -1, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.emit("progress", p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(event.id, str(event.id))
        self.emit("failed" if event.exception else "completed", name, -1, 0)
