"""Exact nearest neighbours over stored vectors, filtered before or after the cut.

Vectors are scanned once for each block of queries and never moved: a task
multiplies its Arrow batches with the block as matrices, keeps the ``k`` nearest
of each query, and sends those alone.  The product only tells which vectors may
be near enough; their distances are then taken exactly, from the first component
on, so that ties are ties whatever the blocks are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Queries, and bytes of them, that all tasks get at once; more come in further scans of the vectors.
MOST_QUERIES, QUERY_BYTES = 50_000, 32 << 20
MOST_NEIGHBOURS = 200
#: Vectors multiplied at once with all queries of a block, by the cells of the product.
CELLS = 1 << 22


def _query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries, in blocks of MOST_QUERIES and QUERY_BYTES at most, about."""
    row = queries.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("q_embedding"), F.lit(0)) * 8 + 64).alias("bytes")).first()
    blocks = max(-(-row["n"] // MOST_QUERIES), -(-(row["bytes"] or 0) // QUERY_BYTES), 1)
    if blocks == 1:
        return [queries]
    numbered = queries.withColumn("__block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)))
    return [numbered.filter(F.col("__block") == b).drop("__block") for b in range(blocks)]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors): those of the column's rows that hold ``width`` finite numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), -1), np.int64)
    fit = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(fit)).flatten().cast(pa.float64())
    m = np.array(flat.fill_null(np.nan) if flat.null_count else flat, np.float64).reshape(len(fit), width)
    whole = np.isfinite(m).all(axis=1)
    return fit[whole], m[whole]


class _Block:
    """The queries of one width, with which a batch's vectors of that width are compared."""

    def __init__(self, at: np.ndarray, vectors: np.ndarray):
        self.at, self.vectors, self.squares = at, vectors, (vectors**2).sum(axis=1)

    def near(self, vectors: np.ndarray, allowed: np.ndarray | None, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance) of the pairs that may be among the ``k`` nearest: within ``bound`` of each query, and no farther than the k-th of these vectors."""
        squares = (vectors**2).sum(axis=1)
        about = self.squares[:, None] + squares[None, :] - 2 * self.vectors @ vectors.T
        slack = 1e-12 * (vectors.shape[1] + 4) * (self.squares[:, None] + squares[None, :]).max(initial=0)  # far above what rounding can do
        if allowed is not None:
            about[~allowed] = np.inf
        limit = bound[self.at] ** 2
        if about.shape[1] > k:
            limit = np.minimum(limit, np.partition(about, k - 1, axis=1)[:, k - 1])
        q, v = np.nonzero((about <= limit[:, None] + 2 * slack) & np.isfinite(about))
        difference = vectors[v] - self.vectors[q]
        return self.at[q], v, np.sqrt(np.cumsum(difference**2, axis=1)[:, -1] if vectors.shape[1] else np.zeros(len(q)))


def _codes(column: pa.Array | pa.ChunkedArray, seen: dict) -> np.ndarray:
    """Each value's number among the queries' values, one number for all others, -1 for a null."""
    return np.array([-1 if v is None else seen.get(v, len(seen)) for v in column.to_pylist()], np.int64)


def _order(value) -> tuple:
    return value is not None, value


def _search(asked: pa.Table, k: int, tie: str, differ: Sequence[tuple[str, str]], names: list[str], kept: list[str]):
    """A task's part: the ``k`` nearest of its vectors for each query, whichever batch they come in."""
    widths: dict[int, list[int]] = {}
    for i, v in enumerate(asked.column("q_embedding").to_pylist()):
        if v is not None:
            widths.setdefault(len(v), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {}
        for width, at in widths.items():
            fit, m = _matrix(asked.column("q_embedding").take(pa.array(at)), width)
            blocks[width] = _Block(np.array(at, np.int64)[fit], m)
        best: list[list[tuple]] = [[] for _ in range(asked.num_rows)]
        bound, rows = np.full(asked.num_rows, np.inf), {}
        seen = {theirs: {v: i for i, v in enumerate(dict.fromkeys(asked.column(theirs).drop_null().to_pylist()))} for _, theirs in differ}
        codes = {theirs: _codes(asked.column(theirs), seen[theirs]) for theirs in seen}
        number = 0
        for batch in batches:
            for width, block in blocks.items():
                fit, m = _matrix(batch.column("embedding"), width)
                step = max(1, CELLS // max(1, len(block.at)))
                for a in range(0, len(fit), step):
                    part = fit[a : a + step]
                    allowed = None
                    for ours, theirs in differ:
                        x, y = codes[theirs][block.at], _codes(batch.column(ours).take(pa.array(part)), seen[theirs])
                        # as in SQL, nothing differs from a null
                        met = (x[:, None] != y[None, :]) & (x >= 0)[:, None] & (y >= 0)[None, :]
                        allowed = met if allowed is None else allowed & met
                    q, v, d = block.near(m[a : a + step], allowed, bound, k)
                    if not len(q):
                        continue
                    ties = batch.column(tie).take(pa.array(part[v])).to_pylist()
                    number += 1
                    for i, row, distance, t in zip(q.tolist(), v.tolist(), d.tolist(), ties):
                        best[i].append((distance, _order(t), number, row))
                    used = set()
                    for i in np.unique(q).tolist():
                        best[i] = sorted(best[i])[:k]
                        used |= {row for _, _, n, row in best[i] if n == number}
                        if len(best[i]) == k:
                            bound[i] = best[i][-1][0]
                    if used:
                        order = sorted(used)
                        rows[number] = ({row: j for j, row in enumerate(order)}, batch.select(kept).take(pa.array(part[order])))
            alive = {n for b in best for _, _, n, _ in b}
            rows = {n: r for n, r in rows.items() if n in alive}
        hits = sorted((n, rows[n][0][row], i, d) for i, b in enumerate(best) for d, _, n, row in b)
        for n in rows:
            mine = [(j, i, d) for m, j, i, d in hits if m == n]
            if mine:
                j, i, d = (list(c) for c in zip(*mine))
                theirs = asked.select([c for c in names if c not in kept]).take(pa.array(i)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*rows[n][1].take(pa.array(j)).columns, *theirs.columns, pa.array(d, pa.float64())], names=[*kept, *theirs.schema.names, "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, tie: str = "id", differ: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(vector columns, query columns, distance, rank) of each query's ``k`` nearest vectors, nearest first, ties by ``tie``.

    vectors: embedding and others; queries: q_id, q_embedding and others.
    ``keep`` speaks of vectors alone, ``differ`` of pairs: a vector's column must
    differ from a query's.  Both hold before the cut, so as many as ``k`` rows
    come back where there are so many.  Vectors and queries that are null, hold
    a null, NaN or infinity, or differ in width have no distance.
    """
    k = max(1, int(k))
    rows = vectors.filter(keep) if keep is not None else vectors
    kept, asked = [c for c in rows.columns if c != "embedding"], [c for c in queries.columns if c != "q_embedding"]
    schema = StructType([rows.schema[c] for c in kept] + [queries.schema[c] for c in asked]).add("distance", DoubleType())
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", tie))
    parts = []
    for block in _query_blocks(queries):
        hits = rows.mapInArrow(_search(block.toArrow(), k, tie, list(differ), [*kept, *asked], kept), schema)
        parts.append(hits.withColumn("rank", rank).filter(F.col("rank") <= k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest_then_filter(vectors: DataFrame, queries: DataFrame, k: int, excluded: int, keep: Column, tie: str = "id") -> DataFrame:
    """The other order: the nearest ``k + excluded`` of all vectors (200 at most), then the filter, then ``k``; fewer may remain."""
    wide = nearest(vectors, queries, min(max(1, k) + excluded, MOST_NEIGHBOURS), None, tie).filter(keep)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", tie))
    return wide.withColumn("rank", rank).filter(F.col("rank") <= k)


def without_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks whose path is not in the change under review."""
    return chunks.join(paths.select("path").distinct(), "path", "left_anti")


def distance_range(hits: DataFrame) -> DataFrame:
    return hits.groupBy("q_id").agg(F.count("*").alias("n"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
