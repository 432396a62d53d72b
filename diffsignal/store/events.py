"""An event log as a table: what jobs and streams tell of themselves, appended as rows."""

from __future__ import annotations

import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.utils import AnalysisException

EVENTS = "run string, at_ms long, seq long, event string, fields map<string,string>"


class EventLog:
    """Events of one ``run`` after another below ``root``; they are held in the driver until ``flush``, a handful a job."""

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run or uuid.uuid4().hex
        self.held: list[tuple] = []
        self.lock, self.seq = threading.Lock(), 0

    def emit(self, event: str, **fields: object) -> None:
        with self.lock:
            self.seq += 1
            self.held.append((self.run, time.time_ns() // 1_000_000, self.seq, event, {k: str(v) for k, v in fields.items() if v is not None}))

    def flush(self) -> None:
        """Append what is held; what cannot be written is held on."""
        with self.lock:
            rows, self.held = self.held, []
        if not rows:
            return
        try:
            self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.root)
        except Exception:
            with self.lock:
                self.held = rows + self.held
            raise

    @contextmanager
    def task(self, name: str, **fields: object):
        """``name.started``, then ``name.finished`` or ``name.failed`` with the error, and a flush."""
        self.emit(f"{name}.started", **fields)
        try:
            yield self
            self.emit(f"{name}.finished", **fields)
        except Exception as error:
            self.emit(f"{name}.failed", **fields, error=f"{type(error).__name__}: {error}"[:500])
            raise
        finally:
            self.flush()

    def read(self) -> DataFrame:
        """All events that were flushed; none where there is no table."""
        try:
            return self.spark.read.schema(EVENTS).parquet(self.root)
        except AnalysisException:
            return self.spark.createDataFrame([], EVENTS)


class StreamEvents(StreamingQueryListener):
    """Progress and end of streaming queries as events; ``log.flush`` writes them."""

    def __init__(self, log: EventLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.emit("stream.started", query=event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.log.emit("stream.progress", query=p.name or p.id, batch=p.batchId, rows=p.numInputRows, **{f"observed.{k}.{c}": v for k, row in p.observedMetrics.items() for c, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.emit("stream.failed" if event.exception else "stream.finished", query=event.id, error=event.exception)
