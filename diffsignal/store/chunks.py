"""Chunks with their vectors, and metadata of repositories, as one table of versions.

A change rewrites the partitions that it touches: a repository's paths are
dealt over SLICES, so one file's refresh rewrites one slice of one repository,
whatever else the index holds.  Chunks and metadata are published by one entry
of the log (see ``log``): a reader sees all of a change or nothing of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import METADATA, STORED_CHUNK
from .log import ACTION, CommitLog, Conflict, Prepared, repo_key

REPOSITORY = ["repo_provider", "repo_name"]
#: Parts of a repository, by path; fixed for a table's life.
SLICES = 16
#: Partitions that are named one by one when they are read; more are found by a join over the table's folders.
NAMED = 4_096
#: How often a change is made again when other writers were first.
ATTEMPTS = 20


def kept_after_delete(chunks: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose keys are not in ``gone``."""
    return chunks.join(gone.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


_COLUMNS = [c.split()[0] for c in STORED_CHUNK.split(", ")]


def _repo() -> Column:
    return repo_key(F.col("repo_provider"), F.col("repo_name")).alias("repo")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"repo": _repo(), "slice": F.pmod(F.xxhash64("path"), F.lit(SLICES)).cast("int")})


class ChunkStore:
    """The chunks below ``root``, partitioned by dimension, repository and slice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def version(self) -> int:
        """The number of the current version, 0 where there is none."""
        return self.log.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.log.live(version))

    def read_repository(self, provider: str, name: str, version: int | None = None) -> DataFrame:
        """One repository's chunks; no other repository's files are listed."""
        return self._rows(self.log.live(version).filter(F.col("repo") == repo_key(F.lit(provider), F.lit(name))))

    def _rows(self, live: DataFrame) -> DataFrame:
        """The chunks in some live partitions."""
        data = f"{self.log.root}/data"
        named = live.select("commit", "repo", "dim", "slice").limit(NAMED + 1).collect()
        read = self.spark.read.schema(f"{STORED_CHUNK}, commit string, repo string, slice int").option("basePath", data)
        if not named:
            return self.spark.createDataFrame([], STORED_CHUNK)
        if len(named) <= NAMED:
            return read.parquet(*[f"{data}/commit={r['commit']}/dim={r['dim']}/repo={r['repo']}/slice={r['slice']}" for r in named]).select(*_COLUMNS)
        return read.parquet(data).join(live.select("commit", "repo", "dim", "slice"), ["commit", "repo", "dim", "slice"], "left_semi").select(*_COLUMNS)

    def change(self, version: int, gone: DataFrame | None = None, added: DataFrame | None = None, dropped: DataFrame | None = None, metadata: DataFrame | None = None, observed: Observation | None = None) -> Prepared:
        """Write a change of version ``version`` and prepare its commit, for any number of repositories at once.

        gone: (repo_provider, repo_name, path) whose chunks go; added: chunks;
        dropped: (repo_provider, repo_name) all of whose chunks go first;
        metadata: rows to save, or with ``gone`` true to delete; observed: gets
        ``chunks``, the number of rows added, from the job that writes them.
        ``added`` is run once, whatever it asks of models, and so is ``gone``,
        whatever it compares: both are written to drafts, as are the slices they touch.
        """
        commit = uuid.uuid4().hex
        draft = f"{self.log.root}/drafts/{commit}"
        live = self.log.live(version).cache()
        try:
            if gone is not None:
                gone = self._drafted(gone.select(*REPOSITORY, "path"), f"{draft}/gone")
            if added is not None:
                more = added.select(*_COLUMNS)
                more = more.observe(observed, F.count(F.lit(1)).alias("chunks")) if observed else more
                added = self._drafted(more, f"{draft}/added", STORED_CHUNK)
            parts = [_keyed(df).select("repo", "slice") for df in (gone, added) if df is not None]
            touched = self._drafted((parts[0].union(parts[1]) if len(parts) > 1 else parts[0]).distinct(), f"{draft}/touched") if parts else None
            return self._prepared(version, commit, live, touched, gone, added, dropped, metadata)
        finally:
            live.unpersist()
            self.log.files.drop(f"drafts/{commit}")

    def _drafted(self, rows: DataFrame, path: str, schema: str | None = None) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(schema or rows.schema).parquet(path)

    def _prepared(self, version: int, commit: str, live: DataFrame, touched: DataFrame | None, gone: DataFrame | None, added: DataFrame | None, dropped: DataFrame | None, metadata: DataFrame | None) -> Prepared:
        old = live.join(touched if touched is not None else self.spark.createDataFrame([], "repo string, slice int"), ["repo", "slice"], "left_semi")
        if dropped is not None:
            whole = live.join(dropped.select(_repo()).distinct(), "repo", "left_semi")
            old, stale = old.join(whole, ["repo", "dim", "slice"], "left_anti"), old.union(whole.select(*old.columns)).distinct()
        else:
            stale = old
        removed = stale.select("repo", "dim", "slice", F.lit(None).cast("string").alias("commit"), F.lit(0).cast("long").alias("rows"))
        if touched is None:
            return self.log.prepare(version, commit, removed, metadata)
        rows = self._rows(old)
        rows = kept_after_delete(rows, gone, [*REPOSITORY, "path"]) if gone is not None else rows
        rows = rows.unionByName(added) if added is not None else rows
        path = f"{self.log.root}/data/commit={commit}"
        # a slice is written by one task, or by more where it is large
        _keyed(rows).hint("rebalance", "dim", "repo", "slice").write.partitionBy("dim", "repo", "slice").parquet(path)
        written = self.spark.read.schema(f"{STORED_CHUNK}, repo string, slice int").parquet(path).groupBy("repo", "dim", "slice").agg(F.count("*").alias("rows"))
        written = written.select("repo", "dim", "slice", F.lit(commit).alias("commit"), "rows")
        actions = removed.join(written, ["repo", "dim", "slice"], "left_anti").unionByName(written)
        return self.log.prepare(version, commit, actions, metadata)

    def transact(self, make: Callable[[int], dict]) -> int:
        """Publish the change that ``make`` describes for a version, made again from the newest one if another writer was first."""
        for _ in range(ATTEMPTS):
            version = self.version()
            try:
                return self.log.publish(self.change(version, **make(version)))
            except Conflict:
                continue
        raise Conflict(f"other writers were first {ATTEMPTS} times")

    def insert(self, rows: DataFrame) -> int:
        return self.transact(lambda _: {"added": rows})

    def rebuild(self, provider: str, name: str, rows: DataFrame) -> int:
        """Replace one repository in every dimension."""
        return self.transact(lambda _: {"dropped": self._one(provider, name), "added": rows})

    def delete_repository(self, provider: str, name: str) -> int:
        return self.transact(lambda _: {"dropped": self._one(provider, name)})

    def delete_paths(self, provider: str, name: str, paths: DataFrame, then: DataFrame | None = None) -> int:
        """Drop a repository's chunks of ``paths`` and add ``then``, in one version."""
        return self.transact(lambda _: {"gone": self._one(provider, name, paths), "added": then})

    def _one(self, provider: str, name: str, paths: DataFrame | None = None) -> DataFrame:
        if paths is None:
            return self.spark.createDataFrame([(provider, name)], "repo_provider string, repo_name string")
        return paths.select("path").distinct().withColumns({"repo_provider": F.lit(provider), "repo_name": F.lit(name)})

    def dimensions(self) -> list[int]:
        """The widths of vectors that are stored: a handful."""
        return sorted(r[0] for r in self.log.live().select("dim").distinct().collect())


class MetadataStore:
    """One row a repository that tells how its index was made, in the log of the chunks below ``root``."""

    KEYS = ["repository_provider", "repository_id"]

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def list(self, version: int | None = None) -> DataFrame:
        return self.log.metadata(version)

    def load(self, provider: str, repository: str, version: int | None = None):
        """The row of one repository, or None."""
        return self.list(version).filter((F.col("repository_provider") == provider) & (F.col("repository_id") == repository)).first()

    def _publish(self, rows: DataFrame) -> None:
        for _ in range(ATTEMPTS):
            try:
                self.log.publish(self.log.prepare(self.log.version(), uuid.uuid4().hex, self.spark.createDataFrame([], ACTION), rows))
                return
            except Conflict:
                continue
        raise Conflict(f"other writers were first {ATTEMPTS} times")

    def save(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in METADATA.split(", ")]
        self._publish(rows.select(*names).withColumn("gone", F.lit(False)))

    def delete(self, provider: str, repository: str) -> None:
        one = self.spark.createDataFrame([(provider, repository)], "repository_provider string, repository_id string")
        rest = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in METADATA.split(", ") if c.split()[0] not in self.KEYS}
        self._publish(one.withColumns(rest | {"gone": F.lit(True)}))
