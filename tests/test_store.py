"""Commits of the index: what readers see when writers stop, race, or are many; and what vacuum leaves."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from diffsignal import models
from diffsignal.plans import indexing
from diffsignal.store import log as commits
from diffsignal.store.chunks import ChunkStore, MetadataStore
from diffsignal.store.log import CommitLog, Conflict

PRINT = indexing.Fingerprint("local", "hash", 4)


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/index"


def trees(spark, tree):
    files = spark.createDataFrame(list(tree.items()), "path string, content string")
    return files, files.select("path", F.sha1("content").alias("oid"))


def refresh(spark, root, name, commit, before, tree, **options):
    files, target = trees(spark, tree)
    base = before if callable(before) else trees(spark, before)[1] if before else None
    return indexing.refresh(spark, ChunkStore(spark, root), MetadataStore(spark, root), "local", name, commit, files, base, target, models.HashEmbedder(4), PRINT, **options).kind


def seen(spark, root, name="r"):
    """What a new reader sees of a repository: its commit and its contents by path."""
    meta = MetadataStore(spark, root).load("local", name)
    return meta["commit_sha"] if meta else None, {r["path"]: r["content"] for r in ChunkStore(spark, root).read_repository("local", name).collect()}


ONE = {"a.txt": "alpha", "b.txt": "beta", "c.txt": "gamma"}
TWO = {"a.txt": "alpha two", "c.txt": "gamma", "d.txt": "delta"}
STEPS = ["data", "actions", "metadata", "draft", "published"]


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_that_stops_leaves_the_old_or_the_new_state(spark, root, monkeypatch, step):
    refresh(spark, root, "r", "c1", None, ONE)

    class Stopped(Exception):
        pass

    def stop(*_a, **_k):
        raise Stopped

    prepare, put = CommitLog.prepare, commits.Files.put
    if step == "data":
        monkeypatch.setattr(CommitLog, "prepare", stop)
    elif step == "actions":
        monkeypatch.setattr(commits, "repo_key", stop)  # between the two tables
        monkeypatch.setattr(CommitLog, "prepare", lambda self, v, c, a, m: prepare(self, v, c, a, m))
    elif step == "metadata":
        monkeypatch.setattr(CommitLog, "publish", stop)
    elif step == "draft":
        monkeypatch.setattr(os, "link", stop)
    else:
        monkeypatch.setattr(commits.Files, "put", lambda self, *a: put(self, *a) and stop())
    with pytest.raises(Stopped):
        refresh(spark, root, "r", "c2", ONE, TWO)
    monkeypatch.undo()
    assert seen(spark, root) == (("c2", TWO) if step == "published" else ("c1", ONE))
    refresh(spark, root, "r", "c3", TWO if step == "published" else ONE, TWO)
    assert seen(spark, root) == ("c3", TWO)
    left = ChunkStore(spark, root).log.vacuum(older_than_s=0)
    assert left >= 1 and seen(spark, root) == ("c3", TWO)


def test_two_writers_of_one_repository(spark, root):
    refresh(spark, root, "r", "c1", None, ONE)
    store = ChunkStore(spark, root)
    rows = lambda tree: indexing.rows_for(trees(spark, tree)[0], "local", "r", "x", models.HashEmbedder(4))
    slow = store.change(store.version(), added=rows({"slow.txt": "s"}))
    store.insert(rows({"fast.txt": "f"}))
    with pytest.raises(Conflict):
        store.log.publish(slow)
    made = []

    def again(version):
        if not made:
            store.insert(rows({"between.txt": "b"}))
        made.append(version)
        return {"added": rows({"slow.txt": "s"})}

    before = store.version()
    assert store.transact(again) == before + 2 and len(made) == 2
    assert set(seen(spark, root)[1]) == {*ONE, "fast.txt", "between.txt", "slow.txt"}


def test_writers_of_different_repositories_both_pass(spark, root):
    store = ChunkStore(spark, root)
    rows = lambda name: indexing.rows_for(trees(spark, ONE)[0], "local", name, "x", models.HashEmbedder(4))
    late = store.change(0, added=rows("late"))
    assert store.rebuild("local", "early", rows("early")) == 1 and store.log.publish(late) == 2
    failed = []

    def write(i):
        try:
            store.insert(rows(f"t{i}"))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.version() == 6
    assert {r[0] for r in store.read().select("repo_name").distinct().collect()} == {"early", "late", "t0", "t1", "t2", "t3"}


def test_a_refresh_plans_again_when_another_was_first(spark, root, monkeypatch):
    history = {"c1": ONE, "c2": TWO}
    refresh(spark, root, "r", "c1", None, ONE)
    publish, raced = CommitLog.publish, []

    def race(self, change):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(CommitLog, "publish", publish)
            refresh(spark, root, "r", "c2", ONE, TWO)
        return publish(self, change)

    monkeypatch.setattr(CommitLog, "publish", race)
    three = {"a.txt": "alpha", "e.txt": "epsilon"}
    assert refresh(spark, root, "r", "c3", lambda commit: trees(spark, history[commit])[1], three) == "incremental"
    assert seen(spark, root) == ("c3", three)
    raced.clear()
    monkeypatch.setattr(CommitLog, "publish", race)
    history["c3"] = three
    with pytest.raises(Conflict):
        refresh(spark, root, "r", "c4", three, ONE)


def test_one_file_writes_one_slice_of_one_repository(spark, root):
    many = {f"f{i}.txt": f"text {i}" for i in range(60)}
    for name in ("r", "s"):
        refresh(spark, root, name, "c1", None, many)
    store = ChunkStore(spark, root)
    before = {tuple(r) for r in store.log.live().select("repo", "slice", "commit").collect()}
    assert len(before) > 20
    refresh(spark, root, "r", "c2", many, many | {"f7.txt": "other"})
    after = {tuple(r) for r in store.log.live().select("repo", "slice", "commit").collect()}
    assert len(after - before) == 1 and len(before - after) == 1
    commit = next(iter(after - before))[2]
    assert [d for d, _, names in os.walk(f"{root[7:]}/data/commit={commit}") if any(n.endswith(".parquet") for n in names)].__len__() == 1
    planned = store.read_repository("local", "r").inputFiles()
    assert planned and not any(f"/repo={next(r for r, _, _ in before if r != next(iter(after - before))[0])}/" in f for f in planned)
    assert seen(spark, root)[1]["f7.txt"] == "other" and seen(spark, root, "s") == ("c1", many)


def test_checkpoints_versions_and_vacuum(spark, root, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT_EVERY", 3)
    states = [{"a.txt": f"v{i}", **({"b.txt": "same"} if i % 2 else {})} for i in range(8)]
    for i, tree in enumerate(states):
        refresh(spark, root, "r", f"c{i}", states[i - 1] if i else None, tree)
    store = ChunkStore(spark, root)
    at = lambda v: {r["path"]: r["content"] for r in store.read(v).collect()}
    assert [at(v) for v in range(1, 9)] == states and at(0) == {}
    assert {r["commit_sha"] for r in store.log.metadata(4).collect()} == {"c3"}
    assert store.log.vacuum(versions=2, older_than_s=3600) == 0
    assert store.log.vacuum(versions=2, older_than_s=0) > 3
    assert at(7) == states[6] and at(8) == states[7] == at(None) and seen(spark, root)[0] == "c7"
    refresh(spark, root, "r", "c8", states[-1], ONE)
    assert seen(spark, root) == ("c8", ONE)


def test_large_sets_of_partitions_are_joined(spark, root, monkeypatch):
    from diffsignal.store import chunks

    refresh(spark, root, "r", "c1", None, ONE)
    refresh(spark, root, "r", "c2", ONE, TWO)
    monkeypatch.setattr(chunks, "NAMED", 1)
    assert seen(spark, root) == ("c2", TWO)


def test_names_are_not_taken_as_paths(spark, root):
    store = ChunkStore(spark, root)
    for name in ("org/repo", "a=b", "..", "ünï code"):
        store.rebuild("https://host", name, indexing.rows_for(trees(spark, {f"{name}.txt": name})[0], "https://host", name, "x", models.HashEmbedder(4)))
    assert {r["repo_name"] for r in store.read().collect()} == {"org/repo", "a=b", "..", "ünï code"}
    store.delete_repository("https://host", "org/repo")
    assert {r["repo_name"] for r in store.read().collect()} == {"a=b", "..", "ünï code"}


def test_put_is_once(spark, root):
    files = commits.Files(spark, root)
    assert files.put("log/1", "a") and not files.put("log/1", "b")
    assert open(f"{root[7:]}/log/1").read() == "a" and files.names("drafts") == {}


class Counting(models.HashEmbedder):
    """Notes every text that it is asked for."""

    def __init__(self, folder):
        super().__init__(4)
        object.__setattr__(self, "folder", folder)

    def embed(self, texts):
        import uuid

        for _ in texts:
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return super().embed(texts)


def test_texts_are_embedded_once(spark, root, tmp_path):
    (tmp_path / "asked").mkdir()
    store = ChunkStore(spark, root)
    store.insert(indexing.rows_for(trees(spark, ONE)[0], "local", "r", "x", Counting(str(tmp_path / "asked"))))
    assert len(os.listdir(tmp_path / "asked")) == len(ONE) and store.log.files.names("drafts") == {}


def test_what_goes_is_found_once(spark, root):
    refresh(spark, root, "r", "c1", None, ONE)
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    gone = spark.createDataFrame([("local", "r", "a.txt"), ("local", "r", "b.txt")], "repo_provider string, repo_name string, path string").mapInArrow(counted, "repo_provider string, repo_name string, path string")
    ChunkStore(spark, root).transact(lambda _: {"gone": gone})
    assert ran.value == 2  # once for each of the two paths
    assert seen(spark, root)[1] == {"c.txt": "gamma"}
    assert not os.listdir(f"{root.removeprefix('file://')}/drafts")
