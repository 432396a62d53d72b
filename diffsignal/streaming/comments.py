"""Review comments kept on their host: one a change, found by its marker, written or brought up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import MARKER

# Comments of a page, and pages that are looked through.
PAGE, PAGES = 50, 5


class Host(Protocol):
    """What a task asks of a host; adapters hold addresses and credentials, and retry what may be retried."""

    def comments(self, target: str, page: int, size: int) -> list[dict]: ...

    def create(self, target: str, body: str) -> None: ...

    def update(self, target: str, comment: object, body: str) -> None: ...


def own_comment(host: Host, target: str) -> dict | None:
    """The comment with the marker among the first PAGES pages; a page that is not full is the last."""
    for page in range(1, PAGES + 1):
        found = host.comments(target, page, PAGE)
        if hit := next((c for c in found if isinstance(c.get("body"), str) and MARKER in c["body"]), None):
            return hit
        if len(found) < PAGE:
            return None
    return None


def upsert(host: Host, target: str, body: str) -> str:
    """created, updated, or same where the host already has this very body."""
    held = own_comment(host, target)
    if held is None:
        host.create(target, body)
        return "created"
    if held["body"] == body:
        return "same"
    host.update(target, held["id"], body)
    return "updated"


def deliver(bodies: DataFrame, host: Host) -> DataFrame:
    """(target, outcome, error) of (target, ts, body) rows: of each target the newest body; one failure stops no other target.

    A target is one task's, so no two tasks look for its comment at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for target, body in zip(batch.column("target").to_pylist(), batch.column("body").to_pylist()):
                try:
                    rows.append((target, upsert(host, target, body), None))
                except Exception as error:  # a host's refusal is data
                    rows.append((target, "failed", f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["target", "outcome", "error"])

    newest = bodies.filter("target IS NOT NULL AND body IS NOT NULL").groupBy("target").agg(F.max_by("body", "ts").alias("body"))
    return newest.repartition("target").mapInArrow(run, "target string, outcome string, error string")


def keep_comments(bodies: DataFrame, host: Host, checkpoint: str, outcomes: str) -> StreamingQuery:
    """A stream of (target, ts, body) to the host; ``outcomes``: a folder for what became of each target, by batch.

    A batch that is run again finds the comments that it wrote and changes
    nothing.  A batch with failures fails after all its targets were tried, so
    it is run again when the query is restarted.
    """

    def batch(frame: DataFrame, number: int) -> None:
        path = f"{outcomes.rstrip('/')}/batch={number}"
        deliver(frame, host).write.mode("overwrite").parquet(path)
        if failed := frame.sparkSession.read.parquet(path).filter("outcome = 'failed'").count():
            raise RuntimeError(f"{failed} comments were not delivered; see {path}")

    return bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
