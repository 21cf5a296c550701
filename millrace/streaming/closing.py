"""Closing a stream early: between two batches, with the counters of those that are done."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryException, StreamingQueryListener


class ClosedEarly(RuntimeError):
    """A batch that came after the stream had been closed; nothing of it is done, so it is done when the stream goes on."""


class Closing(StreamingQueryListener):
    """Counts what finished batches say of themselves and stops the query once ``enough`` of it or ``close`` asks for it.

    A batch is never broken off: the query is stopped when a batch has ended, and a batch that begins all the same is refused
    before it does anything, so it stays the first one when the stream is started again from its checkpoint.
    """

    def __init__(self, enough: Callable[[Counter], bool] = lambda counters: False):
        self.enough, self.counters, self.batches = enough, Counter(), []
        self.query: StreamingQuery | None = None
        self._asked, self._stopped = threading.Event(), threading.Event()

    # -- for the one who starts the stream -----------------------------------------------------------------------------

    def guard(self, work: Callable[[DataFrame, int], dict[str, int]]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: ``work``, which returns its counters, but for batches after the close."""

        def run(batch: DataFrame, number: int) -> None:
            if self._asked.is_set():
                raise ClosedEarly(f"closed before batch {number}")
            found = work(batch, number)
            self.counters.update(found)
            self.batches.append(number)
            if self.enough(self.counters):
                self._asked.set()

        return run

    def watch(self, query: StreamingQuery) -> StreamingQuery:
        self.query = query
        return query

    def close(self) -> None:
        """After the batch that is running."""
        self._asked.set()

    def wait(self, timeout: float | None = None) -> Counter:
        """Until the stream has ended or was closed; the counters of all finished batches. Other failures are raised."""
        try:
            self.query.awaitTermination(timeout) if timeout else self.query.awaitTermination()
        except StreamingQueryException as e:
            if not (self._asked.is_set() and ClosedEarly.__name__ in str(e)):
                raise
        return self.counters

    # -- events --------------------------------------------------------------------------------------------------------

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if self._asked.is_set() and self.query is not None and str(event.progress.id) == str(self.query.id) and not self._stopped.is_set():
            self._stopped.set()
            # Not from the thread that hands out events, which a stop waits for.
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
