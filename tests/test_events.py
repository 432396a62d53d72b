"""The event table, the comment sink and paged payloads."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from diffsignal import models
from diffsignal.functions.text import MARKER
from diffsignal.plans import indexing
from diffsignal.sources.diffs import paged
from diffsignal.store.chunks import ChunkStore, MetadataStore
from diffsignal.store.events import EventLog, StreamEvents
from diffsignal.streaming import comments, deliveries


def test_counts_of_a_refresh_are_those_of_the_table(spark, tmp_path):
    store, meta, log = ChunkStore(spark, f"file://{tmp_path}/i"), MetadataStore(spark, f"file://{tmp_path}/i"), EventLog(spark, f"file://{tmp_path}/e", "run-1")
    assert log.read().count() == 0
    frame = lambda t: spark.createDataFrame(list(t.items()), "path string, content string")
    snap = lambda t: frame(t).select("path", F.sha1("content").alias("oid"))
    one = {f"f{i}.txt": f"text {i} " * 60 for i in range(20)}
    two = {k: v for k, v in one.items() if k != "f3.txt"} | {"f4.txt": "other", "new.txt": "new"}
    go = lambda commit, tree, base: indexing.refresh(spark, store, meta, "local", "r", commit, frame(tree), base if callable(base) else snap(base) if base else None, snap(tree), models.HashEmbedder(4), indexing.Fingerprint("local", "hash", 4), size=200, overlap=20, events=log)
    go("c1", one, None)
    built = store.read().count()
    go("c2", two, one)
    with pytest.raises(Exception, match="broken"):
        go("c3", two, lambda _commit: (_ for _ in ()).throw(ValueError("broken")))
    rows = [(r["event"], r["fields"]) for r in log.read().orderBy("seq").collect()]
    assert [e for e, _ in rows if e.endswith((".started", ".finished", ".failed"))] == ["workflow.index.started", "workflow.index.finished"] * 2 + ["workflow.index.started", "workflow.index.failed"]
    assert [int(f["count"]) for e, f in rows if e == "context.chunks.built"] == [built, 2] and built > 50
    assert [f["n"] for e, f in rows if e == "workflow.index.files.changed"] == ["2"] and [f["n"] for e, f in rows if e == "workflow.index.files.deleted"] == ["1"]
    assert [f["version"] for e, f in rows if e == "workflow.index.published"] == ["1", "2"] and rows[-1][1]["error"].startswith("ValueError")
    assert {r["run"] for r in log.read().collect()} == {"run-1"}


def test_streams_tell_their_progress(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/e")
    listener = StreamEvents(log)
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in/a.json").write_text('{"a": 1}\n{"a": 2}\n')
        q = spark.readStream.schema("a long").json(str(tmp_path / "in")).observe("seen", F.sum("a").alias("total")).writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    log.flush()
    got = {r["event"]: r["fields"] for r in log.read().filter("fields['rows'] = '2' OR event <> 'stream.progress'").collect()}
    assert got["stream.progress"]["observed.seen.total"] == "3" and {"stream.started", "stream.finished"} <= set(got)


class FolderHost:
    """Comments as files of a shared folder; a target named ``down`` refuses."""

    def __init__(self, root):
        self.root = root

    def _all(self, target):
        return [json.loads(p.read_text()) for p in sorted(Path(self.root, target).glob("*.json"))]

    def comments(self, target, page, size):
        if target == "down" and not Path(self.root, "up").exists():
            raise OSError("503")
        return self._all(target)[(page - 1) * size : page * size]

    def _put(self, target, number, body):
        Path(self.root, target).mkdir(exist_ok=True)
        Path(self.root, target, f"{number:05d}.json").write_text(json.dumps({"id": number, "body": body}))

    def create(self, target, body):
        self._put(target, len(self._all(target)), body)

    def update(self, target, comment, body):
        self._put(target, comment, body)


def test_one_comment_a_change_however_often_a_batch_runs(spark, tmp_path):
    host = FolderHost(str(tmp_path))
    for i in range(130):
        host.create("busy", f"comment {i}")
    for i in range(260):
        host.create("far", f"comment {i}")
    rows = [("busy", 1, f"{MARKER} old"), ("busy", 2, f"{MARKER} new"), ("quiet", 1, f"{MARKER} one"), ("far", 1, f"{MARKER} x"), (None, 1, "n"), ("none", 1, None)]
    bodies = spark.createDataFrame(rows, "target string, ts long, body string")
    outcome = lambda: {r["target"]: r["outcome"] for r in comments.deliver(bodies, host).collect()}
    assert outcome() == {"busy": "created", "quiet": "created", "far": "created"}
    assert outcome() == {"busy": "same", "quiet": "same", "far": "created"}, "beyond the pages that are looked through a comment is not found"
    assert [c["body"] for c in host._all("busy") if MARKER in c["body"]] == [f"{MARKER} new"]
    later = spark.createDataFrame([("quiet", 9, f"{MARKER} two")], "target string, ts long, body string")
    assert [r["outcome"] for r in comments.deliver(later, host).collect()] == ["updated"] and len(host._all("quiet")) == 1


def test_comment_stream_runs_a_failed_batch_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"target": t, "ts": 1, "body": f"{MARKER} {t}"}) for t in ("down", "fine")))
    host = FolderHost(str(tmp_path))
    start = lambda: comments.keep_comments(spark.readStream.schema("target string, ts long, body string").json(str(tmp_path / "in")), host, str(tmp_path / "c"), str(tmp_path / "o"))
    with pytest.raises(Exception, match="1 comments were not delivered"):
        start().awaitTermination(120)
    assert len(host._all("fine")) == 1
    (tmp_path / "up").write_text("")
    start().awaitTermination(120)
    assert len(host._all("fine")) == 1 and len(host._all("down")) == 1


class Pages:
    """Keys hold as many items as their name says; the third page of ``120`` fails once, ``9`` always."""

    def __init__(self, root):
        self.root = root

    def __call__(self, key, page):
        asked = Path(self.root, f"{key}-{page}-{len(list(Path(self.root).glob(f'{key}-{page}-*')))}")
        asked.write_text("")
        if (key, page) == ("120", 3) and asked.name.endswith("-0"):
            return 503, ""
        return (404, "") if key == "9" else (200, json.dumps([{"n": i} for i in range(int(key))][(page - 1) * 50 : page * 50]))


def test_pages(spark, tmp_path):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string").repartition(2)
    got = paged(keys("120", "50", "0", "700", None), Pages(str(tmp_path)), sleep=lambda _s: None)
    counts = {r["key"]: (r["n"], r["last"]) for r in got.groupBy("key").agg(F.count("*").alias("n"), F.max("page").alias("last")).collect()}
    assert counts == {"120": (120, 3), "50": (50, 1), "700": (250, 5)}
    asked = [p.name for p in tmp_path.glob("120-*")]
    assert sorted(asked) == ["120-1-0", "120-2-0", "120-3-0", "120-3-1"], "the failing page alone is asked for again"
    with pytest.raises(Exception, match="404"):
        paged(keys("9"), Pages(str(tmp_path)), sleep=lambda _s: None).collect()
    assert deliveries.token_matches("s3", "s3") and not deliveries.token_matches("s3", None) and not deliveries.token_matches("s3", "S3")
