"""Working trees and git trees as DataFrames of files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_indexable, relative_to
from ..operators.chunking import binary_split
from .git import GitTree, Objects, git


def read_tree(spark: SparkSession, root: str, indexable_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the text files below ``root``, and the rejected binary ones.

    Any store that Spark reads will do; only files below the root are listed,
    so no path can lead out of it.  A file that cannot be read fails the job.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = raw.select(F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("full"), F.col("content").alias("bytes"))
    prefix = "/" + root.split(":", 1)[-1].lstrip("/") if not root.startswith("/") else root
    files = base.withColumn("path", relative_to("full", prefix)).filter(F.col("path").isNotNull() & ~F.col("path").rlike(r"(^|/)\.git/")).drop("full")
    return binary_split(files.filter(is_indexable("path")) if indexable_only else files)


def revision(spark: SparkSession, repo: str) -> DataFrame:
    """One row (commit_sha, default_branch) of a local repository."""
    return spark.createDataFrame([(git(repo, "rev-parse", "HEAD").strip(), git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip())], "commit_sha string, default_branch string")


def _tree(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").options(path=repo, **options).load()


def snapshot(spark: SparkSession, repo: str, ref: str = "HEAD", indexable_only: bool = True, prefix: str = "") -> DataFrame:
    """(ref, path, oid) of the blobs of a commit's tree, listed by subtrees in tasks."""
    df = _tree(spark, repo, ref=ref, prefix=prefix).select("ref", "path", "oid")
    return df.filter(is_indexable("path")) if indexable_only else df


def files_at(spark: SparkSession, repo: str, ref: str = "HEAD", indexable_only: bool = True, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(path, content) of the text files of a commit, and the binary ones, read where they are listed."""
    df = _tree(spark, repo, ref=ref, prefix=prefix, content="true").select("path", "bytes")
    return binary_split(df.filter(is_indexable("path")) if indexable_only else df)


def tracked_files(spark: SparkSession, repo: str) -> DataFrame:
    """Paths that git tracks in the working tree, without those never indexed."""
    return _tree(spark, repo, index="true").select("path").filter(is_indexable("path"))


def tree_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """(path, oid) of ``ls-tree`` lines that landed as text; only blobs."""
    parts = F.regexp_extract(line, r"^\d+ (\w+) ([0-9a-f]+)\t(.*)$", 1), F.regexp_extract(line, r"^\d+ (\w+) ([0-9a-f]+)\t(.*)$", 2), F.regexp_extract(line, r"^\d+ (\w+) ([0-9a-f]+)\t(.*)$", 3)
    return lines.select(parts[0].alias("type"), parts[2].alias("path"), parts[1].alias("oid")).filter("type = 'blob'").drop("type")


def read_blobs(rows: DataFrame, repo: str) -> DataFrame:
    """(path, oid, bytes) of (path, oid) rows: one long-lived ``git cat-file --batch`` a task answers in order.

    The repository must be reachable from the executors; an oid that is not
    there gives null bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = Objects(repo)
        try:
            for batch in batches:
                found = pa.array(list(objects.read(batch.column("oid").to_pylist())), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("oid"), found], names=["path", "oid", "bytes"])
        finally:
            objects.close()

    return rows.select("path", "oid").mapInArrow(run, "path string, oid string, bytes binary")


def safe_path(path: str) -> str:
    """A repository-relative path, or ValueError where it is absolute or leads out."""
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError(f"path leads out of the repository: {path}")
    return str(p)
