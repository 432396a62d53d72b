"""The event log: levels, current tasks, job states and their durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of task events by the ending of their name.
ENDINGS = {"started": ("start", "running"), "finished": ("finish", "succeeded"), "failed": ("finish", "failed"), "progress": ("update", "running")}
STATES = ("queued", "running", "completed", "failed")


def log_level(event: Column | str) -> Column:
    """error for failures, warn for retries and truncations, debug for starts, else info."""
    e = F.col(event) if isinstance(event, str) else event
    return F.when(e.endswith(".failed"), "error").when(e.contains("retry") | e.contains("truncated"), "warn").when(e.endswith(".started"), "debug").otherwise("info")


def task_update(event: Column | str) -> Column:
    """struct(kind, task, state) of an event ``<task>.<ending>``; null where it moves no task."""
    e = F.col(event) if isinstance(event, str) else event
    ending, task = F.substring_index(e, ".", -1), F.regexp_extract(e, r"^(?:workflow\.)?(.*)\.[^.]*$", 1)
    out = None
    for name, (kind, state) in ENDINGS.items():
        out = (F if out is None else out).when(ending == name, F.struct(F.lit(kind).alias("kind"), task.alias("task"), F.lit(state).alias("state")))
    return out


def current_tasks(events: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last state of each task, by one aggregate."""
    moved = events.withColumn("u", task_update("event")).filter(F.col("u").isNotNull()).select("*", "u.*")
    return moved.groupBy(*keys, "task").agg(F.max_by("state", order).alias("state"), F.count("*").alias("updates"))


def job_state(transitions: DataFrame, job: str, state: str, order: Column) -> DataFrame:
    """Each job's last state, its times of creation, start and end (epoch ms in ``moved_at``), and its duration where both are known."""
    at = lambda *s: F.min(F.when(F.col(state).isin(*s), F.col("moved_at")))
    per = transitions.groupBy(job).agg(F.max_by(state, order).alias("state"), at("queued").alias("created_at"), at("running").alias("started_at"), F.max(F.when(F.col(state).isin("completed", "failed"), F.col("moved_at"))).alias("finished_at"))
    return per.withColumn("duration_ms", F.when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(), F.col("finished_at") - F.col("started_at")))


def patched(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``current`` with the non-null members of each key's patch."""
    names = [c for c in current.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"__{c}") for c in names if c in patch.columns])
    joined = current.join(renamed, key, "left")
    return joined.select(key, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in patch.columns else F.col(c) for c in names])
