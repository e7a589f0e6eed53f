"""Alerts on a running stream, from its progress events."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC

from pyspark.sql.streaming import StreamingQueryListener

#: Name of the metrics that a watched stream observes: ``oldest``, the earliest arrival in a micro-batch.
INBOX = "inbox"


class Watch(StreamingQueryListener):
    """Raises (alert, value) once each: a failed run, a run too long, a backlog too old, any dead letter.

    Limits are in seconds.  ``raised`` lists what was raised, ``tell`` is called with it on the driver as it happens; a query
    is watched while the listener is registered; ``run_stream`` registers the one it is given, the caller removes it.
    """

    def __init__(self, longest_s: float = 5400, backlog_s: float = 600, tell: Callable[[str, float], None] | None = None, clock: Callable[[], float] = time.time):
        self.longest_s, self.backlog_s, self.tell, self.clock = longest_s, backlog_s, tell, clock
        self.raised: dict[str, float] = {}
        self.began: dict[str, float] = {}

    def _raise(self, alert: str, value: float) -> None:
        if alert not in self.raised and self.tell is not None:
            self.tell(alert, value)
        self.raised.setdefault(alert, value)

    def dead_letters(self, n: int) -> None:
        if n:
            self._raise("dead letters", n)

    def _took(self, run: str) -> None:
        took = self.clock() - self.began.get(run, self.clock())
        if took > self.longest_s:
            self._raise("run too long", took)

    def onQueryStarted(self, event) -> None:
        self.began[str(event.runId)] = self.clock()

    def onQueryProgress(self, event) -> None:
        self._took(str(event.progress.runId))
        seen = event.progress.observedMetrics.get(INBOX)
        if seen is not None and seen["oldest"] is not None:
            age = self.clock() - seen["oldest"].replace(tzinfo=seen["oldest"].tzinfo or UTC).timestamp()
            if age > self.backlog_s:
                self._raise("backlog too old", age)

    def onQueryIdle(self, event) -> None:
        self._took(str(event.runId))

    def onQueryTerminated(self, event) -> None:
        if event.exception is not None:
            self._raise("job failed", 1)
        self._took(str(event.runId))


