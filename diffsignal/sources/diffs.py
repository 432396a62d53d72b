"""Diffs: unified text parsed into files and hunks, and payloads of three hosts mapped to one schema."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETRY_STATUS, ATTEMPTS, BACKOFF_MS = (502, 503, 504), 4, 300


def hunks_of(section: Column) -> Column:
    """array(start_line, end_line, content) of one file's section, on the side of the new file; without a count a hunk is one line."""
    head = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@.*$"
    starts, counts = F.regexp_extract_all(section, F.lit(head), F.lit(1)), F.regexp_extract_all(section, F.lit(head), F.lit(2))
    bodies = F.slice(F.split(section, head, -1), 2, F.size(starts) + 1)
    count = lambda c: F.when(c == "", F.lit(1)).otherwise(c.cast("int"))
    return F.transform(F.arrays_zip(starts.alias("s"), counts.alias("c"), bodies.alias("b")), lambda z: F.struct(z["s"].cast("int").alias("start_line"), (z["s"].cast("int") + F.greatest(count(z["c"]), F.lit(1)) - 1).alias("end_line"), F.trim(z["b"], F.lit("\n")).alias("content")))


def parse_unified(diffs: DataFrame, text: str = "text") -> DataFrame:
    """``diffs`` with one row a file: (pos, path, patch, hunks); a section without a path is ``unknown``."""
    parts = F.filter(F.split(F.col(text), r"(?m)^diff --git ", -1), lambda s: F.trim(s, F.lit(" \t\r\n")) != "")
    rows = diffs.select(*[c for c in diffs.columns if c != text], F.posexplode(parts).alias("pos", "section"))
    path = F.regexp_extract("section", r"a/(.+?) b/(.+)", 2)
    return rows.select(*[c for c in rows.columns if c != "section"], F.when(path != "", path).otherwise("unknown").alias("path"), F.trim("section", F.lit(" \t\r\n")).alias("patch"), hunks_of(F.col("section")).alias("hunks"))


def rebuild_unified(changes: Column) -> Column:
    """Unified text of a merge request's changes: array of (old_path, new_path, diff)."""
    return F.array_join(F.transform(changes, lambda c: F.concat(F.lit("diff --git a/"), c["old_path"], F.lit(" b/"), c["new_path"], F.lit("\n"), c["diff"])), "\n")


# Where hosts keep the common fields in their payloads.
FIELDS = {
    "github": {"title": "$.title", "description": "$.body", "branch": "$.head.ref", "revision": "$.head.sha", "base_revision": "$.base.sha", "repo_id": "$.base.repo.full_name"},
    "gitlab": {"title": "$.title", "description": "$.description", "branch": "$.source_branch", "revision": "$.diff_refs.head_sha", "base_revision": "$.diff_refs.base_sha", "repo_id": "$.references.full"},
    "codeberg": {"title": "$.title", "description": "$.body", "branch": "$.head.ref", "revision": "$.head.sha", "base_revision": "$.base.sha", "repo_id": "$.base.repo.full_name"},
}


def load_result(payloads: DataFrame, provider: str = "provider", payload: str = "payload") -> DataFrame:
    """``payloads`` with title, description, branch, revision, base_revision and repo_id, by each row's host."""
    out = payloads
    for name in FIELDS["github"]:
        value = None
        for host, fields in FIELDS.items():
            value = (F if value is None else value).when(F.col(provider) == host, F.get_json_object(payload, fields[name]))
        out = out.withColumn(name, value)
    return out


def local_diff(spark: SparkSession, repo: str, base: str | None = None) -> DataFrame:
    """One row (revision, base_revision, text): the change of a working tree against the merge base with ``base`` or the origin's head."""
    git = lambda *a: subprocess.run(["git", "-C", repo, *a], capture_output=True, text=True)
    wanted = base or git("rev-parse", "--abbrev-ref", "origin/HEAD").stdout.strip()
    if not wanted or git("rev-parse", "--verify", wanted).returncode:
        raise ValueError("no base: name one, or set the origin's head")
    common = git("merge-base", wanted, "HEAD").stdout.strip() or wanted
    dirty = bool(git("status", "--porcelain").stdout.strip())
    text = git("diff", common, *([] if dirty else ["HEAD"])).stdout
    return spark.createDataFrame([(git("rev-parse", "HEAD").stdout.strip(), common, text)], "revision string, base_revision string, text string")


def get_with_retry(get: Callable[[str], tuple[int, str]], url: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body at ``url``; gateway errors are tried again with a doubling pause, all other errors end it."""
    for i in range(ATTEMPTS):
        status, body = get(url)
        if status < 400:
            return body
        if status not in RETRY_STATUS or i == ATTEMPTS - 1:
            raise OSError(f"{status} from {url}")
        sleep(BACKOFF_MS * 2**i / 1000)
    raise AssertionError


def paged(keys: DataFrame, get: Callable[[str, int], tuple[int, str]], size: int = 50, pages: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, page, position, payload) of the items of each key's JSON pages, for ``keys`` (key); ``get(key, page)`` gives status and body.

    Pages are asked for from 1 on until one is not full or ``pages`` are read.
    A page that fails for a while is tried again alone; pages before it are not.
    """
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column("key").to_pylist():
                for page in range(1, pages + 1):
                    items = json.loads(get_with_retry(lambda _url, k=key, p=page: get(k, p), f"{key}, page {page}", sleep))
                    n = len(items)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([json.dumps(i) for i in items], pa.string())], names=["key", "page", "position", "payload"])
                    if n < size:
                        break

    return keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").mapInArrow(run, "key string, page int, position int, payload string")
