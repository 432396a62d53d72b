"""Hard-negative mining by norm-bucketed search over integer inner products (operator 13).

Rows become blocks of vectors, cut from ranges that are sorted by falling norm:
a block is a bucket of similar norms with its largest as a bound, for no inner
product exceeds the product of the norms (Cauchy-Schwarz).  Anchors come in
rounds of a bounded number of bytes, which every task gets; rows never move.
A task takes its buckets from the largest norm down and multiplies blocks as
matrices.  It keeps the best few rows of each query and

- leaves out a bucket for a query whose bound is below its running kth score,
  or below the lower limit of the window that is searched;
- sends those few rows on, so that a shuffle carries at most ``k`` rows of each
  query and task, of which the best are taken.

Two searches run: the rows of an anchor's own label give its positives; each
positive opens a window of scores, in which rows of other labels are searched.
Each is led by a search of the bucket of the largest norms alone, whose kth
scores are the bounds from which all other tasks start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Bytes of a block, of a range of blocks, and of the anchors that all tasks get in a round.
BLOCK_BYTES, RANGE_BYTES, ROUND_BYTES = 1 << 20, 64 << 20, 32 << 20
#: Doubles hold integers up to this, and so sums of them, exactly.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCKS = "top double, n int, width int, ids binary, labels binary, vectors binary"


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    """The vectors as rows, narrow ones filled with zeros; in 32 bits where they fit."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out.astype(np.int32) if out.size and -(1 << 31) < out.min() and out.max() < 1 << 31 else out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows, which come by falling norm."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        ids, labels, vectors, norms = zip(*held)
        m = _matrix(list(vectors))
        values = [max(norms), len(held), m.shape[1], np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), m.tobytes()]
        kinds = [pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["top", "n", "width", "ids", "labels", "vectors"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector", "norm"))):
            if held and size + 8 * len(row[2]) > BLOCK_BYTES:
                yield out()
                held, size = [], 0
            held.append(row)
            size += 8 * len(row[2]) + 24
    if held:
        yield out()


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows with all, exactly: in doubles where no sum can round, else in integers of 64 bits or of any size, held at a long's ends."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    bound = largest(a) * largest(b) * max(width, 1)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.array([[min(max(sum(p * q for p, q in zip(x, y)), LEAST), MOST) for y in b.tolist()] for x in a.tolist()], np.int64).reshape(len(a), len(b))


class Best:
    """The best ``k`` rows of each of ``n`` queries so far: highest score first, then the smallest id."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, LEAST, np.int64)
        self.query = self.score = self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.append(self.query, query), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((i, ~s, q))  # ~s falls as s grows, without overflow
        q, s, i = q[order], s[order], i[order]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
        kept, last = place < self.k, place == self.k - 1
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        self.kth[q[last]] = s[last]


@dataclass
class Queries:
    """Query ``q`` looks for scores in ``low[q]`` to ``high[q]`` with the anchor ``of[q]``; ``k`` rows are known to reach ``floor[q]``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool

    def search(self, best: Best, norms: np.ndarray, top: float, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bool:
        """Look through one bucket, whose largest norm is ``top``; whether any query had to."""
        need = np.maximum(np.maximum(self.low, self.floor), best.kth)
        wanted = np.flatnonzero(norms[self.of] * top >= need)
        if not len(wanted):
            return False
        anchors, at = np.unique(self.of[wanted], return_inverse=True)
        scores = inner_products(self.vectors[anchors], vectors)
        least = np.full(len(anchors), MOST, np.int64)
        np.minimum.at(least, at, need[wanted])
        mine = self.labels[anchors][:, None] == labels[None, :]
        fits = mine & (self.ids[anchors][:, None] != ids[None, :]) if self.same else ~mine
        x, y = np.nonzero(fits & (scores >= least[:, None]))
        if not len(x):
            return True
        # a hit meets the queries of its anchor, which are as many as positives
        order = np.argsort(at, kind="stable")
        many = np.bincount(at, minlength=len(anchors))
        first, count = (np.cumsum(many) - many)[x], many[x]
        hit = np.repeat(np.arange(len(x)), count)
        query = wanted[order[np.repeat(first, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)]]
        score = scores[x, y][hit]
        within = (score >= need[query]) & (score <= self.high[query])
        best.add(query[within], score[within], ids[y[hit]][within])
        return True


def _norms(vectors: np.ndarray) -> np.ndarray:
    """A little above the true norms, so that rounding prunes nothing."""
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def _found(blocks: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, id, score): the best ``k`` rows of each query, task by task."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best, norms = Best(len(q.of), k), _norms(q.vectors)
        for batch in batches:
            for i in range(batch.num_rows):
                top, n, width, ids, labels, data = (batch.column(c)[i].as_py() for c in ("top", "n", "width", "ids", "labels", "vectors"))
                vectors = np.frombuffer(data, np.int32 if len(data) == 4 * n * width else np.int64).reshape(n, width)
                q.search(best, norms, top, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), vectors)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.id), pa.array(best.score)], names=["query", "id", "score"])

    return blocks.mapInArrow(run, "query long, id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(lead: DataFrame, rest: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, id, score, rank): the first ``k`` rows of each query, whose bounds the bucket ``lead`` sets for the others."""
    led = materialise(_best(_found(lead, queries, k), k), "led")
    known = led.filter(F.col("rank") == k).select("query", "score").toArrow()
    queries.floor[known.column("query").to_numpy()] = known.column("score").to_numpy()
    return materialise(_best(led.drop("rank").union(_found(rest, queries, k)), k), "best")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5, relabel: int = 7, classes: int = 10, percent: int = 80, scale: int = 256) -> DataFrame:
    """Per anchor and positive its first ``k`` negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, embedding and label; other columns are ignored.  A row with
    a null vec_id, label or vector, or with a component that is null, NaN or
    infinite, takes no part; an empty vector has the score 0 with all, and a
    narrower one counts as filled with zeros.  Anchors are the rows whose vec_id
    is divisible by ``every``.  Rows that agree in id, label and vector count
    once; other rows of one id are rows of their own, and an anchor's positives
    have another id than it.
    Scores are exact; beyond a long they are held at its ends.
    """
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is above infinity
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").filter(finite)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    rows = rows.select("vec_id", "label", F.transform("e", number).alias("vector")).distinct()
    rows = materialise(rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), "vectors")
    bytes_ = F.lit(8) * F.size("vector") + 24
    size = rows.agg(F.sum(bytes_).alias("all"), F.sum(F.when(F.col("vec_id") % every == 0, bytes_)).alias("anchors")).first()
    none = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size["anchors"]:
        return none
    # ranges of norms; ties of a norm are split by id
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size["all"] // RANGE_BYTES))
    ordered = rows.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = materialise(ordered.mapInArrow(_blocks, BLOCKS).withColumn("place", F.monotonically_increasing_id()), "blocks")
    first = blocks.agg(F.min("place")).first()[0]
    lead, rest = blocks.filter(F.col("place") == first), blocks.filter(F.col("place") != first)

    rounds = -(-(size["anchors"] * (1 + positives // 2)) // ROUND_BYTES)
    chosen = rows.filter(F.col("vec_id") % every == 0).withColumn("round", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(rounds)))
    out = none
    for i in range(rounds):
        anchors = chosen.filter(F.col("round") == i).select("vec_id", "label", "vector").toArrow()
        if anchors.num_rows:
            out = out.union(_mine(lead, rest, anchors, positives, k, percent))
    return out


def _mine(lead: DataFrame, rest: DataFrame, anchors: pa.Table, positives: int, k: int, percent: int) -> DataFrame:
    """The negatives of one round of anchors."""
    n = anchors.num_rows
    ids, labels, vectors = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vector").to_pylist())
    full = lambda n, v: np.full(n, v, np.int64)
    best = search(lead, rest, Queries(ids, labels, vectors, np.arange(n), full(n, LEAST), full(n, MOST), full(n, LEAST), True), positives)
    # the window of a positive with a negative score is empty
    pairs = best.filter("score >= 0").select("query", "id", "score").toArrow()
    of, positive, high = (pairs.column(c).to_numpy() for c in ("query", "id", "score"))
    low = np.array([-(-percent * s // 100) for s in high.tolist()], np.int64)  # scores are integers
    hits = search(lead, rest, Queries(ids, labels, vectors, of, low, high.copy(), full(len(of), LEAST), False), k)
    session = lead.sparkSession
    windows = session.createDataFrame(pa.table({"query": np.arange(len(of)), "anchor_id": ids[of], "positive_id": positive, "positive_score": high}), "query long, anchor_id long, positive_id long, positive_score long")
    found = hits.join(F.broadcast(windows), "query")  # as many rows as the anchors of a round have positives
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
