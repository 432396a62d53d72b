"""Webhook deliveries as a stream: filtered, deduplicated, handed to a job in micro-batches."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

DELIVERY = "ts timestamp, delivery_id string, provider string, event_type string, action string, url string"
# The events that start a review, by host.
REVIEWED = {"github": ("pull_request", ["opened", "synchronize", "reopened"]), "gitlab": ("Merge Request Hook", ["open", "update", "reopen"])}


def signed_by(secret: bytes, body: bytes, signature: str) -> bool:
    """Whether ``sha256=<hex>`` is the body's signature; compared in constant time."""
    return hmac.compare_digest("sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest(), signature)


def token_matches(secret: str, token: str | None) -> bool:
    """Whether a delivery's plain token, as one host sends it, is the secret; compared in constant time."""
    return hmac.compare_digest(secret.encode(), (token or "").encode())


def read_deliveries(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The stream of deliveries that landed as JSON files below ``path``."""
    return spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files_per_trigger).json(path)


def wanted(deliveries: DataFrame) -> DataFrame:
    """Deliveries of the events that start a review."""
    test = F.lit(False)
    for host, (event, actions) in REVIEWED.items():
        test = test | ((F.col("provider") == host) & (F.col("event_type") == event) & F.col("action").isin(actions))
    return deliveries.filter(test)


def deduplicated(deliveries: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Each delivery id once within ``ttl`` of its event time; the state of older ids is dropped.

    For deliveries that come in order this is the TTL from first registration;
    the batch form for any order is ``operators.ordered.first_seen``.
    """
    return deliveries.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["delivery_id"])


class FirstDeliveries(StatefulProcessor):
    """The deliveries of an id that count, told once no earlier one can come: the first, and the first later than the TTL from the last that counted.

    A row waits in the state until the watermark has passed it; then the rows of
    an id are taken in the order of their times.  When the TTL of the last one
    that counted is over and none waits, a timer clears the state.
    """

    def __init__(self, ttl_us: int, columns: list[str], waiting: str):
        self.ttl_us, self.columns, self.schema = ttl_us, columns, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.counted = handle.getValueState("counted", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = [(_us(r["ts"]), *(r[c] for c in self.columns)) for r in rows]
        self.waiting.appendList(held)
        for us in {h[0] for h in held}:
            self.handle.registerTimer(-(-us // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted((tuple(h) for h in self.waiting.get()), key=lambda h: (h[0], *("" if v is None else str(v) for v in h[1:])))
        due, rest = [h for h in held if h[0] <= upto], [h for h in held if h[0] > upto]
        last = self.counted.get()[0] if self.counted.exists() else None
        for us, *values in due:
            if last is None or us - last > self.ttl_us:
                last = us
                yield Row(delivery_id=key[0], ts=_time(us), **dict(zip(self.columns, values)))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if due and last is not None:
            self.counted.update((last,))
            self.handle.registerTimer((last + self.ttl_us) // 1000 + 1)
        elif last is not None and not rest and upto > last + self.ttl_us:
            self.counted.clear()


def _us(ts: datetime) -> int:
    return round((ts.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def _time(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)


def first_deliveries(deliveries: DataFrame, ttl_seconds: int = 3600, delay: str = "1 minute") -> DataFrame:
    """The stream form of ``operators.ordered.first_seen``: the same rows, in whatever order deliveries come within ``delay``.

    Rows are (delivery_id, ts, other columns) and come when the watermark has
    passed them; what is later than ``delay`` is left out.  ``deduplicated``
    answers at once, by another rule for deliveries out of order.
    """
    columns = [c for c in deliveries.columns if c not in ("delivery_id", "ts")]
    kinds = "".join(f", `{c}` {deliveries.schema[c].dataType.simpleString()}" for c in columns)
    processor = FirstDeliveries(ttl_seconds * 1_000_000, columns, f"us long{kinds}")
    return deliveries.withWatermark("ts", delay).groupBy("delivery_id").transformWithState(processor, f"delivery_id string, ts timestamp{kinds}", "Append", "EventTime")


def run(deliveries: DataFrame, checkpoint: str, job: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each micro-batch of new deliveries to ``job``; what is there is worked off, then it stops.

    ``job`` may see a batch again after a failure, so it must be idempotent.
    """
    return deduplicated(wanted(deliveries)).writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
