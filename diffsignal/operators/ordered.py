"""Order-sensitive operators: first of duplicates, rank and cap, budget prefixes, fixed batches, first-seen TTL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; null keys are equal to each other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def rank_and_cap(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key as (rank, shown, total); the first row carries the marker where rows are missing."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumns({"rank": F.row_number().over(by.orderBy(*order)), "total": F.count("*").over(by)}).filter(F.col("rank") <= cap)
    shown = F.least(F.col("total"), F.lit(cap))
    marked = (F.col("rank") == 1) & (F.col("total") > shown)
    return ranked.withColumns({"shown": shown, "truncated": F.when(marked, F.struct(shown.cast("int").alias("shown"), F.col("total").cast("int").alias("total")))})


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], length: Column, budget: int) -> DataFrame:
    """Each key's longest prefix in ``order`` whose lengths sum to ``budget`` or less, with the running sum as ``used``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(length).over(before)).filter(F.col("used") <= budget)


def fixed_batches(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Rows of each key numbered into batches of ``size``, from 0."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(number / size))


def first_seen(df: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """(key, ts) of the deliveries that count: the first of a key, and the first later than its TTL from the one that counted last.

    A repeat does not extend the TTL.  A key with any number of deliveries is
    folded over several ranges of its times (see ``folds``).
    """
    times = df.filter(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).distinct()
    counted = folds.grouped(times, [key], ["us"], F.col("us"), folds.Spans(ttl_seconds * 1_000_000))
    return counted.filter("begins").select(key, F.timestamp_micros("us").alias(ts))


def trailing_sum(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, budget: int | None = None) -> DataFrame:
    """``used``: the sum of ``value`` over the trailing time range, its oldest instant included; ``admitted``: it fits the budget or is alone."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    out = df.withColumns({"used": F.sum(value).over(window), "in_window": F.count("*").over(window)})
    return out if budget is None else out.withColumn("admitted", (F.col("used") <= budget) | (F.col("in_window") == 1))
