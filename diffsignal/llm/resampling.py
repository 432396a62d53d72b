"""Importance resampling of documents towards a target distribution (operator 12).

Features are a text's words and word pairs, hashed into BUCKETS buckets.  The
gain of a bucket is the scaled log ratio of its smoothed shares in the target
and in the corpus, a text's weight the mean gain of its features, and its score
the weight plus Gumbel noise drawn from its id: taking the highest scores is
drawing without replacement in proportion to the weights.

1. bucket counts of all texts, summed in each task before they are shuffled;
   the gains are an array of BUCKETS numbers, and texts are scored by indexing it.
2. every partition of scored documents is written as a run, sorted by score.
3. the cut: two histograms of scores, of as many cells as scores have values
   (scores are bounded, whatever the corpus), give the score of the last draw.
   What lies below is never moved.
4. regular samples of the runs cut the order into ranges; a range's segments
   of all runs are merged by a tournament tree, which stops at the last draw.
   Its first rank is the number of rows in the ranges before it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

BUCKETS = 10_000
#: Bytes of a text whose words are in memory at once; bounds memory, never what is read.
PIECE = 1 << 20
#: Rows of a range, about; and samples taken for each range's two ends.
RANGE_ROWS, SAMPLES = 500_000, 16
#: Scores of a cell of the first histogram.
CELL = 1_024
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_OUTSIDE = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def features(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of their words and word pairs) of a text, piece after piece."""
    a, last = 0, None
    while a < len(data):
        cut = _OUTSIDE.search(data, a + PIECE)
        b = cut.start() if cut else len(data)
        words = data[a:b].translate(_TO_WORDS).split()
        if words:
            one = [zlib.crc32(w) for w in words]
            # the checksum of "x y" goes on from that of "x"
            two = [zlib.crc32(b" " + w, c) for c, w in zip(one if last is None else [last, *one], words[1:] if last is None else words)]
            last = one[-1]
            yield len(words), np.array(one + two, np.int64) % BUCKETS
        a = b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text").cast(pa.large_binary()):
            for _, found in features(text.as_py() or b""):
                total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; a task sends a row a bucket."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(s + b) / (float(x + 1) * float(t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def _array(counts: DataFrame) -> np.ndarray:
    """The counts as one array of BUCKETS numbers."""
    out = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise from the first 32 bits of sha256("seed:doc_id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _weights(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.large_binary()):
                n_words = n = total = 0
                for words, found in features(text.as_py() or b""):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
                rows.append((n_words, n, total // n if n else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[:, i]) for i in range(3))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def last_score(eligible: DataFrame, draw: int) -> int:
    """The score of the ``draw``-th highest row: the cell that holds it, then its place in that cell."""
    above, cell = 0, None
    for low, n in sorted(((r[0], r[1]) for r in eligible.groupBy(F.floor(F.col("score") / CELL).cast("long").alias("cell")).count().collect()), reverse=True):
        if above + n >= draw:
            cell = low
            break
        above += n
    fine = eligible.filter((F.col("score") >= cell * CELL) & (F.col("score") < (cell + 1) * CELL)).groupBy("score").count().collect()
    for score, n in sorted(((r[0], r[1]) for r in fine), reverse=True):
        above += n
        if above >= draw:
            return score
    raise AssertionError("fewer rows than draws")


class Tournament:
    """A loser tree over sorted lists: ``winner`` is the list whose head comes first, ``next`` moves on in it."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _head(self, r: int) -> tuple | None:
        return self.runs[r][self.at[r]] if r < len(self.runs) and self.at[r] < len(self.runs[r]) else None

    def _before(self, r: int, s: int) -> bool:
        a, b = self._head(r), self._head(s)
        return a is not None and (b is None or a <= b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        r, s = self._play(2 * node), self._play(2 * node + 1)
        first, self.losers[node] = (r, s) if self._before(r, s) else (s, r)
        return first

    def next(self) -> tuple | None:
        """The first of all heads, taken off its list; only the games on its path to the root are played again."""
        r = self.winner
        head = self._head(r)
        if head is None:
            return None
        self.at[r] += 1
        node = (r + self.size) >> 1
        while node:
            if self._before(self.losers[node], r):
                r, self.losers[node] = self.losers[node], r
            node >>= 1
        self.winner = r
        return head


def _merge(first: dict[int, int], draw: int, schema: list[str]):
    def run(table: pa.Table) -> pa.Table:
        """A range's rows in order with their ranks; after the last draw the rest comes as it lies, without one."""
        number = table.column("range")[0].as_py()
        left = max(0, draw - first[number])
        score, doc_id, uid = (table.column(c).to_numpy() for c in ("score", "doc_id", "uid"))
        runs = uid >> 33
        order = np.argsort(runs, kind="stable")
        ends = np.flatnonzero(np.diff(runs[order], append=-1)) + 1
        lists = []
        for a, b in zip([0, *ends[:-1]], ends):
            rows = order[a:b]
            rows = rows[np.argsort(uid[rows])]  # a run's segment as it was written
            lists.append(list(zip((-score[rows]).tolist(), doc_id[rows].tolist(), uid[rows].tolist(), rows.tolist())))
        tree, taken = Tournament(lists), []
        while len(taken) < left and (head := tree.next()) is not None:
            taken.append(head[3])
        rest = np.ones(len(score), bool)
        rest[taken] = False
        rows = pa.array(np.concatenate([np.array(taken, np.int64), np.flatnonzero(rest)]))
        ranks = pa.array([*range(first[number] + 1, first[number] + 1 + len(taken)), *[None] * (len(score) - len(taken))], pa.int64())
        return table.select(schema).take(rows).append_column("rank", ranks)

    return run


def ranked(runs: DataFrame, draw: int, parts: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows of ``runs``, which are sorted within their partitions; rank is null from ``draw`` on.

    runs: a written table with score, doc_id and uid, whose upper 31 bits tell
    the run and the lower 33 the place in it; all rows are eligible.
    """
    names = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return runs.select(*names, F.lit(None).cast("long").alias("rank"))
    cut = last_score(runs, draw)
    top = runs.filter(F.col("score") >= cut)
    n = top.count()
    parts = max(parts, -(-n // RANGE_ROWS))
    step = max(1, n // (SAMPLES * parts))
    # each run's every step-th row, from a place of its own
    sampled = top.filter(F.pmod(F.col("uid") + F.shiftright("uid", 33) * 7919, F.lit(step)) == 0)
    keys = sorted((-r["score"], r["doc_id"], r["uid"]) for r in sampled.select("score", "doc_id", "uid").collect())
    cuts = [keys[i] for i in range(SAMPLES, len(keys), SAMPLES)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            score, doc_id, uid = (batch.column(c).to_pylist() for c in ("score", "doc_id", "uid"))
            at = [bisect_right(cuts, (-s, d, u)) for s, d, u in zip(score, doc_id, uid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "range"])

    columns = ", ".join(f"{c} long" for c in [*names, "uid", "range"])
    placed = top.select(*names, "uid").mapInArrow(place, columns)
    sizes = {r[0]: r[1] for r in placed.groupBy("range").count().collect()}
    first, before = {}, 0
    for number in sorted(sizes):
        first[number], before = before, before + sizes[number]
    merged = placed.groupBy("range").applyInArrow(_merge(first, draw, names), ", ".join(f"{c} long" for c in [*names, "rank"]))
    return merged.union(runs.filter(F.col("score") < cut).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Per document (doc_id, n_features, weight, score, rank); rank is null where it is not drawn.

    docs: doc_id and text; target: text; other columns are ignored.  A null or
    empty text has no features and the weight 0.  floor(percent * N / 100) of
    the N documents with ``min_words`` words are drawn, the highest scores
    first, ties to the smaller doc_id.  Every row is a document of its own: rows
    of one id and score stand in a fixed order of their runs.  A null doc_id has
    no noise: its score is null and it is never drawn nor counted in N, but its
    text counts in the corpus.  Tables without rows give none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(_array(bucket_counts(texts)), _array(bucket_counts(target)))
    weighed = texts.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("eligible", F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words))
    scored = scored.sortWithinPartitions(F.desc("eligible"), F.desc("score"), "doc_id", "n_features").withColumn("uid", F.monotonically_increasing_id())
    runs = materialise(scored, "runs")
    able = runs.filter("eligible")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = ranked(able, percent * able.count() // 100, parts)
    return drawn.union(runs.filter("NOT eligible").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
