"""Progress of streaming queries as events, at most one in a while."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


def to_stderr(event: dict) -> None:
    print(json.dumps(event), file=sys.stderr, flush=True)


class Progress(StreamingQueryListener):
    """Tells ``emit`` when a query starts, how far it is, and when it ends. Between two events of a query there are at
    least ``interval`` seconds, except for the first and the last, and none where nothing came since. Counts of a
    query's observations are added up over its batches, also over those that were not told of."""

    def __init__(self, emit: Callable[[dict], None] = to_stderr, interval: float = 2.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.emit, self.interval, self.clock = emit, interval, clock
        self.told: dict[str, float] = {}
        self.rows: dict[str, int] = {}
        self.counts: dict[str, dict[str, int]] = {}
        self.last: dict[str, int] = {}
        self.names: dict[str, str] = {}

    def add(self, query: str, batch: int, rows: int, observed: dict[str, dict[str, int]]) -> None:
        """A batch is over."""
        self.rows[query] = self.rows.get(query, 0) + rows
        counts = self.counts.setdefault(query, {})
        for name, values in observed.items():
            for key, n in values.items():
                counts[f"{name}.{key}"] = counts.get(f"{name}.{key}", 0) + n
        now = self.clock()
        if query in self.told and (now - self.told[query] < self.interval or self.rows[query] == self.last.get(query)):
            return
        self.told[query] = now
        self._tell(query, "progress", batch=batch)

    def end(self, query: str, error: str | None = None) -> None:
        self._tell(query, "ended", **({"error": error} if error else {}))
        for kept in (self.told, self.rows, self.counts, self.last):
            kept.pop(query, None)

    def _tell(self, query: str, phase: str, **more: object) -> None:
        self.last[query] = self.rows.get(query, 0)
        self.emit({"query": query, "phase": phase, "rows": self.last[query], **self.counts.get(query, {}), **more})

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self._tell(self.names[str(event.id)], "started")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        observed = {k: {c: v for c, v in row.asDict().items() if isinstance(v, int)} for k, row in (p.observedMetrics or {}).items()}
        self.add(p.name or str(p.id), p.batchId, p.numInputRows, observed)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.end(self.names.pop(str(event.id), str(event.id)), event.exception)
