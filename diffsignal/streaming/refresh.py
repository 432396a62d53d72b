"""A chunk index that follows a stream of commits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(commits: DataFrame, checkpoint: str, refresh: Callable[[str, str, str], None], threads: int = 4) -> StreamingQuery:
    """For each repository of a micro-batch, refresh its index to the newest commit of (ts, provider, name, commit_sha).

    Commits between are skipped, as a refresh compares snapshots.  The list is
    one row a repository that moved since the last trigger; ``threads`` of them
    are refreshed at once, as commits of different repositories do not conflict.
    All are tried before the first failure ends the batch, which is run again.
    """

    def batch(frame: DataFrame, _number: int) -> None:
        latest = frame.groupBy("provider", "name").agg(F.max_by("commit_sha", "ts").alias("commit_sha"))
        failed: list[Exception] = []

        def one(row: Row) -> None:
            try:
                refresh(row["provider"], row["name"], row["commit_sha"])
            except Exception as error:
                failed.append(error)

        with ThreadPoolExecutor(threads) as pool:
            running: deque = deque()
            for row in latest.toLocalIterator():  # as many rows are held as are refreshed
                if len(running) == 2 * threads:
                    running.popleft().result()
                running.append(pool.submit(one, row))
        if failed:
            raise failed[0]

    return commits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_sink(checkpoint: str, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame], StreamingQuery]:
    """A sink that keeps one row a key, the newest; replayed batches change nothing."""
    from ..store.chunks import upsert

    def start(stream: DataFrame) -> StreamingQuery:
        def batch(frame: DataFrame, _number: int) -> None:
            newest = frame.groupBy(*keys).agg(F.max_by(F.struct(*frame.columns), "ts").alias("r")).select("r.*")
            write(upsert(read(), newest.select(*read().columns), keys))

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start
