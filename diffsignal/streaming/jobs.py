"""Job states as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

# The states that may follow each state.
FOLLOWS = {None: {"queued"}, "queued": {"running", "failed"}, "running": {"completed", "failed"}, "completed": set(), "failed": set()}
ORDER = {"queued": 0, "running": 1, "completed": 2, "failed": 2}
OUTPUT = "id string, state string, created_at long, started_at long, finished_at long, duration_ms long"
STATE = "state string, created long, started long, finished long"


class JobStates(StatefulProcessor):
    """Moves each job by its transitions; with ``keep_ms`` a job is forgotten so long after its last move."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", STATE, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now, created, started, finished = self.job.get() if self.job.exists() else (None, None, None, None)
        for at, s in sorted(((r["moved_at"], r["state"]) for r in rows), key=lambda m: (m[0], ORDER.get(m[1], 3))):
            if s not in FOLLOWS[now]:
                continue
            now = s
            created, started, finished = (at, started, finished) if s == "queued" else (created, at, finished) if s == "running" else (created, started, at)
        self.job.update((now, created, started, finished))
        took = finished - started if started is not None and finished is not None else None
        yield Row(id=key[0], state=now, created_at=created, started_at=started, finished_at=finished, duration_ms=took)


def job_states(transitions: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A job's row after each micro-batch of (id, moved_at, state) transitions; moves that may not follow are ignored.

    ``keep_ms`` bounds the state of a query that runs on and on; one that works
    off what is there and ends (availableNow) takes none, as it would wait for
    the clock.
    """
    return transitions.groupBy("id").transformWithState(JobStates(keep_ms), OUTPUT, "Update", "None" if keep_ms is None else "ProcessingTime")
