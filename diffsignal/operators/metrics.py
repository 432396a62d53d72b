"""Metrics over repeated runs, their score, and the statistics of one review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

KEYS = ["scenario", "model"]
# Weights of the score.
FAILURE, HALLUCINATION, VARIANCE, TOKEN, SIGNAL = 5, 10, 1, 0.001, 2


def matrix(scenarios: DataFrame, models: DataFrame, runs: int = 3) -> DataFrame:
    """Every scenario with every model and run number: two lists of names, so the product is the plan itself."""
    return scenarios.crossJoin(F.broadcast(models)).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def structural(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count_if(F.col("outcome") != "success").alias("failures"), F.count_if(F.col("n_signals") == 0).alias("empty"))


def stability(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """variance: the mean distance of the runs' signal counts from the first run's; avg_signals.

    The first run's count is found by an aggregate, and the distances need no
    window: both are sums of what one pass collects by count.
    """
    per = runs.groupBy(*keys, "n_signals").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    base = F.min_by("n_signals", "first")
    counts = F.collect_list(F.struct("n_signals", "n"))
    got = per.groupBy(*keys).agg(base.alias("base"), counts.alias("c"), F.sum("n").alias("runs"), F.sum(F.col("n") * F.col("n_signals")).alias("total"))
    off = F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x["n_signals"] - F.col("base")) * x["n"])
    return got.select(*keys, (off / F.col("runs")).alias("variance"), (F.col("total") / F.col("runs")).alias("avg_signals"))


def grounding(signals: DataFrame, valid: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """hallucinated: signals whose file is not in ``valid`` (keys or file); keys without any count 0."""
    known = valid.select("file").distinct().withColumn("__known", F.lit(True))
    return signals.join(known, "file", "left").groupBy(*keys).agg(F.count("*").alias("n_signals"), F.count_if(F.col("__known").isNull()).alias("hallucinated"))


def tokens(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Averages over runs that tell their usage; tokens per signal and second, 0 without signals or time."""
    n = F.greatest(F.count("total_tokens"), F.lit(1))
    total = F.coalesce(F.sum("total_tokens"), F.lit(0))
    avg = lambda c: (F.coalesce(F.sum(c), F.lit(0)) / n).alias(f"avg_{c}")
    return runs.groupBy(*keys).agg(
        avg("total_tokens"), avg("prompt_tokens"), avg("completion_tokens"), ratio(total, F.sum("n_signals")).alias("tokens_per_signal"), ratio(total * 1000, F.sum("duration_ms")).alias("tokens_per_second")
    )


def latency(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg("duration_ms").alias("avg_latency_ms"), F.max("duration_ms").alias("max_latency_ms"))


def score(failures: Column, hallucinated: Column, total_signals: Column, avg_signals: Column, variance: Column, avg_tokens: Column) -> Column:
    """Higher is better: signals count for a model, failures, invented files, unsteady counts and tokens against it."""
    rate = ratio(hallucinated, total_signals)
    per_signal = F.when(total_signals > 0, avg_tokens / avg_signals).otherwise(avg_tokens)
    return -FAILURE * failures - HALLUCINATION * rate - VARIANCE * variance - TOKEN * per_signal + SIGNAL * avg_signals


def scores(runs: DataFrame, hallucinated: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """All metrics of each (scenario, model), the total of signals and the score."""
    total = runs.groupBy(*keys).agg(F.sum("n_signals").alias("total_signals"))
    every = structural(runs, keys).join(stability(runs, keys), keys).join(tokens(runs, keys), keys).join(latency(runs, keys), keys).join(total, keys)
    every = every.join(hallucinated.select(*keys, "hallucinated"), keys, "left").withColumn("hallucinated", F.coalesce("hallucinated", F.lit(0)))
    value = score(F.col("failures"), F.col("hallucinated"), F.col("total_signals"), F.col("avg_signals"), F.col("variance"), F.col("avg_total_tokens"))
    return every.withColumn("score", value)


def review_stats(reviews: DataFrame) -> DataFrame:
    """Rates of (total_signals, total_tokens, duration_ms, hallucinated) rows; tokens per signal is all tokens without signals."""
    signals, tokens_, ms = F.col("total_signals"), F.col("total_tokens"), F.col("duration_ms")
    return reviews.withColumns({
        "tokens_per_signal": ratio(tokens_, signals, tokens_.cast("double")), "signals_per_second": ratio(signals * 1000, ms), "tokens_per_second": ratio(tokens_ * 1000, ms), "hallucination_rate": ratio(F.col("hallucinated"), signals),
    })
