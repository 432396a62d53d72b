"""Repeated runs of scenarios against models, evaluated and written as a report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stamp
from ..models import Model, answer, with_timeout
from ..operators import metrics
from ..operators.signals import parse_output


def run(scenarios: DataFrame, models: dict[str, Model], runs: int = 3, timeout_ms: int = 60_000, threads: int = 1) -> DataFrame:
    """(scenario, model, run, duration_ms, outcome, n_signals, files, tokens) of every scenario (scenario, prompt) with every model.

    A call ends after ``timeout_ms``, answered or not.
    """
    out = None
    for name, model in models.items():
        asked = scenarios.withColumn("model", F.lit(name)).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
        got = parse_output(answer(asked, with_timeout(model, timeout_ms / 1000), threads=threads).withColumnsRenamed({"outcome": "asked", "error": "failed"}))
        got = got.withColumn("outcome", F.when(F.col("asked") != "success", F.col("asked")).otherwise(F.col("outcome")))
        files = F.transform("raw", lambda s: s["file"])
        got = got.select("scenario", "model", "run", "duration_ms", "outcome", F.when(F.col("raw").isNotNull(), F.size("raw")).otherwise(0).alias("n_signals"), F.coalesce(files, F.array().cast("array<string>")).alias("files"), "prompt_tokens", "completion_tokens", "total_tokens")
        out = got if out is None else out.unionByName(got)
    return out


def evaluate(runs: DataFrame, valid: DataFrame) -> DataFrame:
    """All metrics and the score of each (scenario, model); valid: (file) that the change really has."""
    named = runs.select("scenario", "model", F.explode("files").alias("file"))
    return metrics.scores(runs, metrics.grounding(named, valid).select("scenario", "model", "hallucinated"))


def write_report(report: DataFrame, folder: str) -> str:
    """The report as one JSON file in a folder named by the time, without colons."""
    spark = report.sparkSession
    iso = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    stamp = spark.range(1).select(file_stamp(F.lit(iso))).first()[0]
    report.coalesce(1).write.json(f"{folder}/{stamp}")  # one row a scenario and model
    return f"{folder}/{stamp}"


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
