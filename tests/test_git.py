"""A git tree as a partitioned source."""

import subprocess

import pytest
from pyspark.sql import functions as F

from diffsignal.sources import files as sources
from diffsignal.sources import git as tree


def imported(root, files, branch="main"):
    """A bare repository with one commit of (path, bytes) files, made by one stream."""
    subprocess.run(["git", "init", "-q", "--bare", "-b", branch, str(root)], check=True)
    out = [f"commit refs/heads/{branch}\ncommitter t <t@t> 1700000000 +0000\ndata 1\nx\n".encode()]
    for path, content in files:
        out.append(f'M 100644 inline "{path}"\ndata {len(content)}\n'.encode() + content + b"\n")
    subprocess.run(["git", "-C", str(root), "fast-import", "--quiet"], input=b"".join(out), check=True)
    return str(root)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """100,000 paths: a folder of 30,000 files, 2,000 folders, and a chain of nested ones."""
    paths = [f"flat/f{i}.ts" for i in range(30_000)] + [f"pkg{i % 40}/src{i % 50}/f{i}.ts" for i in range(69_900)] + ["/".join(["deep"] * d) + f"/x{d}.ts" for d in range(1, 101)]
    return imported(tmp_path_factory.mktemp("git") / "large", [(p, b"const a = 1;") for p in paths]), set(paths)


def test_all_paths_of_a_large_repository(spark, large):
    repo, paths = large
    rows = sources.snapshot(spark, repo, "main")
    assert {r["path"] for r in rows.collect()} == paths and rows.count() == len(paths) == 100_000
    planned = tree.Reader(repo, "main", "", False, False).partitions()
    assert len(planned) == tree.PARTITIONS
    assert sum(f.prefix == "flat/" and not f.deep for p in planned for f in p.folders) >= 2
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) < 0.35 * len(paths)


def test_path_filters_prune_subtrees(spark, large, monkeypatch):
    repo, paths = large
    reader = tree.Reader(repo, "main", "", False, False)
    assert list(reader.pushFilters([tree.StringStartsWith(("path",), "pkg3/src1"), tree.StringStartsWith(("oid",), "a")]))
    assert reader.prefix == "pkg3/" and all(f.prefix.startswith("pkg3/") for p in reader.partitions() for f in p.folders)
    one = tree.Reader(repo, "main", "", False, False)
    list(one.pushFilters([tree.In(("path",), ("flat/f7.ts", "deep/x1.ts", "none/x.ts"))]))
    assert {f.prefix for p in one.partitions() for f in p.folders} == {"flat/", "deep/"}
    df = sources.snapshot(spark, repo, "main")
    assert {r["path"] for r in df.filter(F.col("path").startswith("pkg3/src1")).collect()} == {p for p in paths if p.startswith("pkg3/src1")}
    assert [r["path"] for r in df.filter("path = 'flat/f7.ts'").collect()] == ["flat/f7.ts"]
    assert df.filter("path IN ('none/a.ts', 'flat/none.ts')").collect() == []
    assert sources.snapshot(spark, repo, "main", prefix="deep/deep/").count() == 99 and sources.snapshot(spark, repo, "main", prefix="none").count() == 0


def test_contents_names_and_batches(spark, tmp_path, monkeypatch):
    files = [("a b/ü.ts", "grüße".encode()), ("bin.ts", b"a\0b"), ("empty.ts", b""), ("LICENSE", b"no"), *((f"m/f{i}.ts", f"text {i}\n".encode() * (i + 1)) for i in range(700))]
    repo = imported(tmp_path / "r", files)
    text, rejects = sources.files_at(spark, repo, "main")
    assert {(r["path"], r["content"]) for r in text.collect()} == {(p, c.decode()) for p, c in files if p not in ("bin.ts", "LICENSE")}
    assert [r["path"] for r in rejects.collect()] == ["bin.ts"]
    monkeypatch.setattr(tree, "BYTES", 50)
    reader = tree.Reader(repo, "main", "m", True, False)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 500 and {x for b in batches for x in b.column("bytes").to_pylist()} == {c for p, c in files if p.startswith("m/")}
    with pytest.raises(Exception, match="git"):
        sources.snapshot(spark, repo, "no-such-ref").count()
