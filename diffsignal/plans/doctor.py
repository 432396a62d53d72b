"""Checks of what the engine needs, as a small table."""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Issue
from ..schemas import CHECK

# A capability's status as a check's.
STATUS = {"ready": "ok", "missing": "fail", "partial": "warn", "non-applicable": "ok"}
Capability = Callable[[], tuple[str, str]]


def git_repository(path: str) -> Capability:
    def check() -> tuple[str, str]:
        try:
            found = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
        except OSError:
            return "missing", "git is not installed"
        return ("ready", found.stdout.strip()) if found.returncode == 0 else ("missing", "not a git repository")

    return check


def data_folder(spark: SparkSession, root: str) -> Capability:
    """Whether Spark can write below ``root``."""

    def check() -> tuple[str, str]:
        try:
            spark.range(1).write.parquet(f"{root}/check-{uuid.uuid4().hex}")
        except Exception as e:
            return "missing", str(e).splitlines()[0]
        return "ready", root

    return check


def model_list(wanted: list[str], installed: list[str]) -> Capability:
    """Whether all wanted models are installed, by name or by name and tag."""

    def check() -> tuple[str, str]:
        lacking = [w for w in wanted if not any(i == w or i.startswith(f"{w}:") for i in installed)]
        return ("ready", "all installed") if not lacking else ("partial" if len(lacking) < len(wanted) else "missing", ", ".join(lacking))

    return check


def diagnose(spark: SparkSession, capabilities: dict[str, Capability], issues: list[Issue] = []) -> DataFrame:
    """(name, status, detail) of every capability and configuration issue."""
    rows = [(name, STATUS[status], detail) for name, (status, detail) in ((n, c()) for n, c in capabilities.items())]
    return spark.createDataFrame(rows + [(i.path, "fail", i.message) for i in issues], CHECK)


def failures(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_or(F.col("status") == "fail"), F.lit(False)).alias("failed"), F.count_if(F.col("status") == "fail").alias("n_failed"))
