"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import measured


def _edges(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``edges`` written, with their number and the sum of their hashes, by which a round that changes nothing is told."""
    out, seen = measured(edges, "edges", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return out, (seen["n"], seen["h"] or 0)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of an edge the smallest node it can reach.

    Every round first ties each node's larger neighbours to the smallest
    neighbour, then its smaller ones; the edges end as stars around each
    component's minimum after about log(n) rounds.  Minima are aggregated
    before the shuffle, so a hub's edges never meet in one group; a round's
    edges are written to the shared folder.  Null or equal ends are no edges.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    now, state = _edges(ends.filter("x AND y AND u > v").select("u", "v").distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(floor.select("u", F.col("m").alias("v"))).distinct()
        before = state
        now, state = _edges(small)
        if state == before:
            break
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
