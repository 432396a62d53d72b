"""The Spark session that the engine expects: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "diffsignal", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword settings use underscores for dots."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()
