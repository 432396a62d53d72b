"""Commits of the index: numbered entries of a log, each of which makes a whole change visible at once.

Below the root lie

- ``data/commit=C/dim=D/repo=R/slice=S``: chunk files that commit C wrote;
- ``actions/C``: the partitions (repo, dim, slice) that C replaced or removed;
- ``metadata/C``: the metadata rows that C saved or deleted;
- ``drafts``: what a writer needs until it is done;
- ``log/N``: names the commit of version N.  It is put there only if no other
  writer has put that number: this one step makes C visible;
- ``checkpoints/N``: the live partitions and metadata as of version N.

Data, actions and metadata are tables that Spark writes and reads; the driver
holds numbers and names of commits.  What no entry names does not exist for a
reader, so a writer may stop anywhere.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METADATA

ACTION = "repo string, dim int, slice int, commit string, rows long"
SAVED = f"{METADATA}, repo string, gone boolean"
#: Commits after which the state is written as a whole; readers look at so many entries at most.
CHECKPOINT_EVERY = 16


class Conflict(Exception):
    """Another writer has changed the same repository since the version that a change was made from."""


def repo_key(provider: Column, name: Column) -> Column:
    """One string of hexadecimal digits a repository, which needs no escapes in paths."""
    return F.substring(F.sha2(F.concat(provider, F.lit("\0"), name), 256), 1, 32)


@dataclass(frozen=True)
class Prepared:
    """A change that is written but not yet visible: the version it was made from, and its commit."""

    version: int
    commit: str


class Files:
    """The few file operations that a log needs, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder with their times of change in milliseconds; none where there is no folder."""
        at = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def text(self, below: str) -> str:
        """What a small file holds."""
        stream = self.fs.open(self.path(below))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, below: str, text: str) -> bool:
        """Put a file there unless there is one; it appears whole.  False if another was first."""
        target, draft = self.path(below), self.path(f"drafts/{uuid.uuid4().hex}")
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.local:  # a local rename replaces what is there; a link does not
                plain = lambda p: urlparse(p.toString()).path
                os.link(plain(draft), plain(target))
            else:
                kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
                self.jvm.java.lang.reflect.Array.set(options, 0, kinds.NONE)
                self.context.rename(draft, target, options)
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False
        finally:
            self.fs.delete(draft, False)
        return True

    def drop(self, below: str) -> None:
        self.fs.delete(self.path(below), True)


class CommitLog:
    """Versions of an index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def version(self) -> int:
        """The number of the newest version, 0 where there is none."""
        return max((int(n.split(".")[0]) for n in self.files.names("log")), default=0)

    def entries(self, after: int, upto: int) -> list[tuple[int, str]]:
        """(version, commit) of the log's entries with ``after`` < version <= ``upto``."""
        return [(n, json.loads(self.files.text(f"log/{n:020d}.json"))["commit"]) for n in range(after + 1, upto + 1)]

    def _checkpoint(self, upto: int) -> int:
        whole = [int(n) for n in self.files.names("checkpoints") if int(n) <= upto and "_SUCCESS" in self.files.names(f"checkpoints/{n}/metadata")]
        return max(whole, default=0)

    def _folded(self, kind: str, version: int | None, schema: str, keys: list[str], gone: Column) -> DataFrame:
        """The last row of each key as of a version, without those that tell of a removal."""
        upto = self.version() if version is None else version
        since = self._checkpoint(upto)
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/checkpoints/{since}/{kind}").withColumn("v", F.lit(since))] if since else []
        parts += [self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{commit}").withColumn("v", F.lit(v)) for v, commit in self.entries(since, upto)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        names = [c for c in rows.columns if c != "v"]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys]), "v").alias("last"))
        return last.select(*keys, "last.*").filter(~gone).select(*names)

    def live(self, version: int | None = None) -> DataFrame:
        """(repo, dim, slice, commit, rows) of the partitions that make up a version."""
        return self._folded("actions", version, ACTION, ["repo", "dim", "slice"], F.col("commit").isNull())

    def metadata(self, version: int | None = None) -> DataFrame:
        rows = self._folded("metadata", version, SAVED, ["repository_provider", "repository_id"], F.col("gone"))
        return rows.drop("repo", "gone")

    def prepare(self, version: int, commit: str, actions: DataFrame, metadata: DataFrame | None) -> Prepared:
        """Write what a commit does to partitions and metadata; nothing of it is visible yet."""
        actions.select("repo", F.col("dim").cast("int"), F.col("slice").cast("int"), "commit", F.col("rows").cast("long")).write.parquet(f"{self.root}/actions/{commit}")
        rows = metadata if metadata is not None else self.spark.createDataFrame([], SAVED)
        rows.withColumn("repo", repo_key(F.col("repository_provider"), F.col("repository_id"))).select(*[f.split()[0] for f in SAVED.split(", ")]).write.parquet(f"{self.root}/metadata/{commit}")
        return Prepared(version, commit)

    def publish(self, change: Prepared) -> int:
        """Make a prepared change the next version.

        Another writer may have published since: if its commits touched other
        repositories the change moves on to the next free number, else it was
        made from what is no longer there, and Conflict is raised.
        """
        at = change.version
        while not self.files.put(f"log/{at + 1:020d}.json", json.dumps({"version": at + 1, "commit": change.commit})):
            for _, other in self.entries(at, at + 1):
                if not self._touched(other).join(self._touched(change.commit), "repo", "left_semi").isEmpty():
                    raise Conflict(f"version {at + 1} changed the same repository")
            at += 1
        if (at + 1) % CHECKPOINT_EVERY == 0:
            self.checkpoint(at + 1)
        return at + 1

    def _touched(self, commit: str) -> DataFrame:
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{commit}").select("repo")
        return read("actions", ACTION).union(read("metadata", SAVED)).distinct()

    def checkpoint(self, version: int) -> None:
        """Write the whole state of a version, from which readers start; it changes nothing that can be read."""
        if self._checkpoint(version) == version:
            return
        live, rows = self.live(version), self.metadata(version)
        saved = rows.withColumns({"repo": repo_key(F.col("repository_provider"), F.col("repository_id")), "gone": F.lit(False)})
        live.write.mode("overwrite").parquet(f"{self.root}/checkpoints/{version}/actions")
        saved.write.mode("overwrite").parquet(f"{self.root}/checkpoints/{version}/metadata")  # its end tells that the checkpoint is whole

    def vacuum(self, versions: int = 1, older_than_s: float = 7 * 86_400.0) -> int:
        """Drop what none of the last ``versions`` needs, and what was left by writers that stopped; how many folders went.

        Folders that changed in the last ``older_than_s`` seconds stay, as a
        writer may be about to publish them or a reader be reading them.
        """
        import time

        now = self.version()
        oldest = max(1, now - versions + 1)
        if not now:
            return 0
        self.checkpoint(oldest)
        needed = self.live(oldest)
        for v in range(oldest + 1, now + 1):
            needed = needed.union(self.live(v))
        needed = needed.select("commit", "repo", "dim", "slice").distinct().cache()
        kept, dropped, before = {r["commit"] for r in needed.select("commit").distinct().toLocalIterator()}, 0, (time.time() - older_than_s) * 1000
        pending = {c for _, c in self.entries(oldest, now)}
        for name, changed in self.files.names("data").items():
            commit = name.removeprefix("commit=")
            if changed >= before:
                continue
            if commit not in kept:
                self.files.drop(f"data/{name}")
                dropped += 1
            elif "_SUCCESS" in self.files.names(f"actions/{commit}"):
                added = self.spark.read.schema(ACTION).parquet(f"{self.root}/actions/{commit}").filter(F.col("commit") == commit)
                for r in added.join(needed, ["commit", "repo", "dim", "slice"], "left_anti").toLocalIterator():
                    self.files.drop(f"data/{name}/dim={r['dim']}/repo={r['repo']}/slice={r['slice']}")
                    dropped += 1
        for kind in ("actions", "metadata"):
            for commit, changed in self.files.names(kind).items():
                if changed < before and commit not in pending and commit not in kept:
                    self.files.drop(f"{kind}/{commit}")
        for name, changed in self.files.names("drafts").items():
            if changed < before:
                self.files.drop(f"drafts/{name}")
        for name in self.files.names("log"):
            if int(name.split(".")[0]) < oldest:
                self.files.drop(f"log/{name}")
        for name in self.files.names("checkpoints"):
            if int(name) < self._checkpoint(oldest):
                self.files.drop(f"checkpoints/{name}")
        needed.unpersist()
        return dropped
