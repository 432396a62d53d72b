"""Index maintenance, review, bench, configuration and streams from end to end."""

import itertools
import json
import os
import random
import subprocess
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from diffsignal import config, models
from diffsignal.operators import chunking, ordered, signals
from diffsignal.plans import benching, doctor, indexing, reviewing
from diffsignal.sources import files as sources
from diffsignal.sources.diffs import parse_unified
from diffsignal.store.chunks import ChunkStore, MetadataStore
from diffsignal.streaming import deliveries, jobs, refresh

PRINT = indexing.Fingerprint("local", "hash", 16)


class Repo:
    """An index of one repository whose versions are dicts of path to content."""

    def __init__(self, spark, root):
        self.spark, self.store, self.meta = spark, ChunkStore(spark, f"{root}/index"), MetadataStore(spark, f"{root}/index")
        self.before = {}

    def to(self, commit, tree, **options):
        frame = lambda t: self.spark.createDataFrame(list(t.items()), "path string, content string")
        snap = lambda t: frame(t).select("path", F.sha1("content").alias("oid"))
        name = options.pop("name", "r")
        print_ = options.pop("fingerprint", PRINT)
        plan = indexing.refresh(self.spark, self.store, self.meta, "local", name, commit, frame(tree), snap(self.before), snap(tree), models.HashEmbedder(print_.embedding_dimension), print_, size=500, overlap=50, **options)
        if not options.get("dry_run"):
            self.before = tree
        return plan.kind

    def held(self, path):
        return [r["content"] for r in self.store.read().filter(F.col("path") == path).collect()]


def test_incremental_index(spark, tmp_path):
    repo = Repo(spark, tmp_path)
    one = {"a.txt": "const a = 1;", "LICENSE": "no"}
    assert repo.to("c1", one) == "full" and repo.held("a.txt") == ["const a = 1;"] and repo.held("LICENSE") == []
    assert repo.to("c1", one) == "noop"
    assert repo.to("c2", {"a.txt": "const a = 2;"}) == "incremental" and repo.held("a.txt") == ["const a = 2;"]
    assert repo.to("c3", {"a.txt": "const a = 2;", "b.ts": "const b = 42;"}) == "incremental" and "42" in repo.held("b.ts")[0]
    assert repo.to("c4", {"a.txt": "const a = 2;", "c.ts": "const b = 42;"}) == "incremental" and repo.held("b.ts") == [] and repo.held("c.ts")
    assert repo.to("c5", {"a.txt": "const a = 2;", "c.ts": "const b = 42;"}) == "noop"
    assert repo.to("c6", {"c.ts": "const b = 42;"}, dry_run=True) == "delete-only" and repo.held("a.txt")
    assert repo.to("c6", {"c.ts": "const b = 42;"}) == "delete-only" and repo.held("a.txt") == []
    assert repo.meta.load("local", "r")["commit_sha"] == "c6" and repo.meta.list().count() == 1


def test_dimensions_live_side_by_side(spark, tmp_path):
    repo = Repo(spark, tmp_path)
    eight = indexing.Fingerprint("local", "hash", 8)
    repo.to("c1", {"a.txt": "x"})
    repo.before = {}
    repo.to("c1", {"a.txt": "x"}, name="s", fingerprint=eight)
    assert repo.store.dimensions() == [8, 16]
    assert repo.to("c2", {"a.txt": "y"}, fingerprint=eight) == "incompatible"
    assert repo.to("c2", {"a.txt": "y"}, fingerprint=eight, force=True) == "full" and repo.store.dimensions() == [8]
    repo.store.delete_repository("local", "r")
    assert [r["repo_name"] for r in repo.store.read().collect()] == ["s"]
    repo.meta.delete("local", "r")
    assert repo.meta.load("local", "r") is None


def test_git_sources(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("const a = 1;\n")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "LICENSE").write_text("x")
    git("add", "-A")
    git("commit", "-qm", "one")
    text, rejects = sources.read_tree(spark, str(tmp_path))
    assert [tuple(r) for r in text.select("path", "content").collect()] == [("src/a.ts", "const a = 1;\n")]
    assert [r["path"] for r in rejects.collect()] == ["b.bin"]
    snap = sources.snapshot(spark, str(tmp_path))
    assert sorted(r["path"] for r in snap.collect()) == ["b.bin", "src/a.ts"]
    blobs = {r["path"]: r["bytes"] for r in sources.read_blobs(snap.unionByName(spark.createDataFrame([("HEAD", "no", "0" * 40)], snap.schema)), str(tmp_path)).collect()}
    assert bytes(blobs["src/a.ts"]) == b"const a = 1;\n" and blobs["no"] is None
    assert sources.revision(spark, str(tmp_path)).count() == 1 and sources.tracked_files(spark, str(tmp_path)).count() == 2
    listed = spark.createDataFrame([("100644 blob abc\tx y.ts",), ("160000 commit abd\tsub",)], "value string")
    assert [tuple(r) for r in sources.tree_listing(listed).collect()] == [("x y.ts", "abc")]


def _canned(prompt):
    if "src/bad.ts" in prompt:
        raise RuntimeError("no answer")
    many = [("high", 0.95, "one"), ("medium", 0.9, "two"), ("high", 0.95, "one"), ("low", 0.5, "three"), ("odd", 0.9, "four")]
    return "```json\n" + json.dumps({"signals": [{"type": "bug", "severity": s, "confidence": c, "file": "src/a.ts", "lineStart": 3, "message": m} for s, c, m in many]}) + "\n```"


DIFF = "diff --git a/src/a.ts b/src/a.ts\n@@ -1 +1,2 @@\n+export function f(a: number): void {}\ndiff --git a/src/bad.ts b/src/bad.ts\n@@ -1 +1 @@\n+x\n"


def test_review_ranks_caps_and_isolates_failures(spark, tmp_path):
    changed = parse_unified(spark.createDataFrame([(DIFF,)], "text string"))
    out = reviewing.review(changed, {}, models.CannedModel(_canned), threshold=0.8, top=5)
    rows = out.signals.orderBy("rank").collect()
    assert [(r["rank"], r["severity"], r["message"], r["total_before_cap"]) for r in rows] == [(1, "high", "one", 2), (2, "medium", "two", 2)]
    assert {(r["file"], r["outcome"]) for r in out.results.collect()} == {("src/a.ts", "success"), ("src/bad.ts", "failure")}
    totals = signals.usage_totals(out.results.withColumn("k", F.lit(1)), ["k"]).first()
    assert totals["failed_files"] == 1 and not totals["all_failed"] and totals["total_tokens"] > 0
    empty = reviewing.review(changed.limit(0), {}, models.CannedModel(_canned))
    assert empty.signals.count() == 0 and empty.results.count() == 0


def test_review_with_context(spark, tmp_path):
    repo = Repo(spark, tmp_path)
    base = {"src/a.ts": "export function f(a: string): void {}\n", "src/use.ts": "import { f } from './a';\nf(1);\n", "notes.txt": "about f"}
    repo.to("c1", base)
    changed = parse_unified(spark.createDataFrame([(DIFF,)], "text string"))
    rag = reviewing.rag_context(changed, repo.store.read(), models.HashEmbedder(), "local", "r", k=3)
    assert {r["path"] for r in rag.collect()} == {"src/use.ts", "notes.txt"}
    frame = lambda t: spark.createDataFrame(list(t.items()), "path string, content string")
    graph = reviewing.symbol_context(changed, frame(base | {"src/a.ts": "export function f(a: number): void {}\n"}), frame(base))
    assert [(r["path"], r["line_start"]) for r in graph["references"].collect()] == [("src/use.ts", 2)]
    prompts = reviewing.review(changed, graph | {"rag": rag}, models.CannedModel(_canned), title="T").prompts
    prompt = prompts.filter("file = 'src/a.ts'").first()["prompt"]
    assert prompt.index("## PR Title\nT") < prompt.index("### Direct callers") < prompt.index("// src/use.ts:2\nf(1);") < prompt.index("### Similar code")


def test_heritage_breaks_reach_the_prompt(spark):
    base = {"src/port.ts": "export interface Port { load(id: string): void; same(): void }\n", "src/adapter.ts": "import { Port } from './port';\nexport class Adapter implements Port {\n  load(id: string): void {}\n  same(): void {}\n}\n"}
    head = base | {"src/port.ts": "export interface Port { load(id: number): void; save(): void; same(): void }\n"}
    diff = "diff --git a/src/port.ts b/src/port.ts\n@@ -1 +1 @@\n+x\n"
    frame = lambda t: spark.createDataFrame(list(t.items()), "path string, content string")
    graph = reviewing.symbol_context(parse_unified(spark.createDataFrame([(diff,)], "text string")), frame(head), frame(base))
    rows = graph["references"].collect()
    assert len(rows) == 1 and rows[0]["path"] == "src/adapter.ts"
    assert "// stale member: load (shape changed on Port)" in rows[0]["content"] and "// missing member: save (added to Port)" in rows[0]["content"]


def test_bench(spark, tmp_path):
    scenarios = spark.createDataFrame([("s1", "p"), ("s2", "src/bad.ts")], "scenario string, prompt string")
    runs = benching.run(scenarios, {"m": models.CannedModel(_canned)}, runs=3)
    report = benching.evaluate(runs, spark.createDataFrame([("src/a.ts",)], "file string"))
    got = {r["scenario"]: r for r in report.collect()}
    assert got["s1"]["failures"] == 0 and got["s1"]["avg_signals"] == 5 and got["s1"]["variance"] == 0 and got["s2"]["failures"] == 3 and got["s2"]["empty"] == 3
    where = benching.write_report(report, str(tmp_path / "out"))
    assert ":" not in where.rsplit("/", 1)[1] and benching.load_baseline(spark, where).count() == 2


def test_greedy_folds_against_loops(spark):
    import random

    rng = random.Random(3)
    lists = [[rng.randint(0, 40) for _ in range(rng.randint(0, 30))] for _ in range(50)]

    def packs(sizes, most, count):
        out, held, n, pack = [], 0, 0, 0
        for x in sizes:
            if n and (held + x > most or n >= count):
                held, n, pack = 0, 0, pack + 1
            held, n = held + x, n + 1
            out.append(pack)
        return out

    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<long>")
    got = {r["i"]: r["p"] for r in df.select("i", chunking.greedy_packs(F.col("x"), 60, 4).alias("p")).collect()}
    assert got == {i: packs(x, 60, 4) for i, x in enumerate(lists)}


def test_request_packs_and_budget():
    assert [len(p) for p in models.request_packs(["a"] * 2049)] == [2048, 1]
    assert models.request_packs(["x" * 10, "y" * 1000, "z"], tokens=20) == [["x" * 10], ["y" * 1000], ["z"]]
    now, pauses = [0.0], []
    budget = models.TokenBudget(100, lambda: now[0], lambda s: (pauses.append(s), now.__setitem__(0, now[0] + s + 0.01)))
    budget.admit(80)
    budget.admit(500)
    assert pauses and budget.spent == [(now[0], 500)]
    budget.learn(1000)
    assert budget.budget == 900


def test_models_are_wrapped():
    calls = []

    class Flaky:
        def generate(self, prompt):
            calls.append(prompt)
            if len(calls) < 3:
                raise OSError("busy")
            return models.Reply("ok")

    assert models.with_retries(Flaky(), 2, sleep=lambda _s: None).generate("p").text == "ok" and len(calls) == 3
    with pytest.raises(TimeoutError):
        models.with_timeout(models.CannedModel(lambda p: p), -1).generate("p")
    with pytest.raises(ValueError):
        models.embedder_for("nobody")


def test_configuration():
    merged, issues = config.resolve({"index": {"chunk_size": 100}}, {"index": {"chunk_overlap": 100}, "review": {"labels": [1]}}, {"review": {"labels": None}})
    assert merged["index"] == {"chunk_size": 100, "chunk_overlap": 100} and merged["review"]["labels"] is None
    assert [i.path for i in issues] == ["index.chunk_overlap"] and config.issues_for(issues, ["review"]) == []
    assert ("llm.model", "canned") in config.flatten(merged) and config.clean({"a": None, "b": 1}) == {"b": 1}
    assert config.load_yaml("/nowhere.yml") == {} and config.table_text([("a", "1"), ("bcd", "2")]) == "a    1\nbcd  2"


def test_doctor(spark, tmp_path):
    checks = doctor.diagnose(spark, {"git": doctor.git_repository(str(tmp_path)), "data": doctor.data_folder(spark, str(tmp_path / "d")), "models": doctor.model_list(["a", "b"], ["a:7b"])}, config.validate({}))
    status = {r["name"]: r["status"] for r in checks.collect()}
    assert (status["git"], status["data"], status["models"]) == ("fail", "ok", "warn") and doctor.failures(checks).first()["failed"]


def test_ttl_counts_from_the_first(spark):
    rows = [("a", 0), ("a", 3000), ("a", 3600), ("a", 3601), ("a", 5000), ("b", 10)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = {(r["k"], r["s"]) for r in ordered.first_seen(df, "k", "ts", 3600).select("k", F.unix_timestamp("ts").alias("s")).collect()}
    assert got == {("a", 0), ("a", 3601), ("b", 10)}


def test_delivery_stream(spark, tmp_path):
    landed, seen = tmp_path / "in", []
    landed.mkdir()
    event = lambda i, ts, kind="pull_request": {"ts": f"2024-01-01T00:{ts:02d}:00Z", "delivery_id": i, "provider": "github", "event_type": kind, "action": "opened", "url": "u"}
    (landed / "a.json").write_text("\n".join(json.dumps(e) for e in [event("1", 0), event("1", 5), event("2", 6), event("3", 7, "push")]))
    q = deliveries.run(deliveries.read_deliveries(spark, str(landed)), str(tmp_path / "cp"), lambda df, _n: seen.extend(r["delivery_id"] for r in df.collect()))
    q.awaitTermination(120)
    assert sorted(seen) == ["1", "2"]
    assert deliveries.signed_by(b"k", b"body", "sha256=" + __import__("hmac").new(b"k", b"body", "sha256").hexdigest()) and not deliveries.signed_by(b"k", b"body", "sha256=0")


def test_first_deliveries_equal_the_batch_form_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    base, ttl = 1_700_000_000, 100
    rows = [(str(rng.randrange(12)), base + rng.randrange(2000), f"u{i}") for i in range(240)]
    # batches in order of time, shuffled by up to the delay within and between them
    rows.sort(key=lambda r: r[1] + rng.randrange(60))
    (tmp_path / "in").mkdir()
    for i in range(0, 240, 40):
        lines = [json.dumps({"delivery_id": d, "ts": datetime.fromtimestamp(t, UTC).isoformat(), "url": u}) for d, t, u in rows[i : i + 40]]
        (tmp_path / f"in/{i:03d}.json").write_text("\n".join(rng.sample(lines, len(lines))))
        os.utime(tmp_path / f"in/{i:03d}.json", (base + i, base + i))
    (tmp_path / "in/999.json").write_text(json.dumps({"delivery_id": "end", "ts": datetime.fromtimestamp(base + 9000, UTC).isoformat(), "url": "e"}))
    stream = spark.readStream.schema("delivery_id string, ts timestamp, url string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = deliveries.first_deliveries(stream, ttl, "120 seconds")
    out.writeStream.format("memory").queryName("first_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r["delivery_id"], int(r["ts"].timestamp())) for r in spark.table("first_rows").collect())
    batch = ordered.first_seen(spark.createDataFrame([(d, datetime.fromtimestamp(t, UTC)) for d, t, _ in rows], "delivery_id string, ts timestamp"), "delivery_id", "ts", ttl)
    assert got == sorted((r["delivery_id"], int(r["ts"].timestamp())) for r in batch.collect()) and len(got) > 60
    assert {r["url"] for r in spark.table("first_rows").collect()} <= {u for _, _, u in rows}


def test_job_stream_equals_batch(spark, tmp_path):
    moves = [("j1", 1, "queued"), ("j1", 2, "running"), ("j1", 9, "completed"), ("j2", 3, "queued"), ("j2", 4, "completed"), ("j3", 5, "queued"), ("j3", 6, "running")]
    spark.createDataFrame(moves, "id string, moved_at long, state string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.job_states(spark.readStream.schema("id string, moved_at long, state string").json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("job_rows").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: (r["state"], r["duration_ms"]) for r in spark.table("job_rows").collect()}
    assert got == {"j1": ("completed", 7), "j2": ("queued", None), "j3": ("running", None)}


def test_commit_stream_and_upsert_sink(spark, tmp_path):
    rows = [("2024-01-01T00:00:00Z", "local", "r", "c1"), ("2024-01-01T00:01:00Z", "local", "r", "c2")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(dict(zip(("ts", "provider", "name", "commit_sha"), r))) for r in rows))
    read = lambda: spark.readStream.schema("ts timestamp, provider string, name string, commit_sha string").json(str(tmp_path / "in"))
    seen = []
    refresh.follow(read(), str(tmp_path / "c1"), lambda *a: seen.append(a)).awaitTermination(120)
    assert seen == [("local", "r", "c2")]
    (tmp_path / "in/b.json").write_text("\n".join(json.dumps({"ts": "2024-01-01T00:02:00Z", "provider": "local", "name": f"n{i}", "commit_sha": "c"}) for i in range(20)))

    def half(_provider, name, _commit):
        seen.append(name)
        if name == "n3":
            raise ValueError("refused")

    with pytest.raises(Exception, match="refused"):
        refresh.follow(read(), str(tmp_path / "c1"), half).awaitTermination(120)
    assert set(seen[1:]) == {f"n{i}" for i in range(20)}, "one failure stops no other repository"
    (tmp_path / "in/b.json").unlink()
    held = [spark.createDataFrame([], "ts timestamp, provider string, name string, commit_sha string")]
    start = refresh.upsert_sink(str(tmp_path / "c2"), lambda: held[0], lambda df: held.__setitem__(0, spark.createDataFrame(df.collect(), df.schema)), ["provider", "name"])
    start(read()).awaitTermination(120)
    assert [r["commit_sha"] for r in held[0].collect()] == ["c2"]


class Hanging:
    def __init__(self):
        self.cancelled = 0

    def generate(self, prompt):
        if "hang" in prompt:
            __import__("time").sleep(600)
        return models.Reply(prompt)

    def cancel(self):
        self.cancelled += 1


def test_a_hanging_model_ends_within_its_limit(spark):
    began, hanging = __import__("time").monotonic(), Hanging()
    with pytest.raises(TimeoutError):
        models.with_timeout(hanging, 0.2).generate("hang")
    assert hanging.cancelled == 1 and models.with_timeout(hanging, 5).generate("a").text == "a"
    prompts = spark.createDataFrame([(i, "hang" if i % 3 == 0 else f"p{i}") for i in range(12)], "i int, prompt string").coalesce(1)
    rows = models.answer(prompts, models.with_timeout(Hanging(), 1), threads=4).collect()
    assert [(r["i"], r["outcome"]) for r in rows] == [(i, "timeout" if i % 3 == 0 else "success") for i in range(12)]
    assert __import__("time").monotonic() - began < 60


class Strict:
    """Refuses inputs above 300 characters, and its second request for its rate."""

    dimension, max_chars = 2, 3000

    def __init__(self):
        self.asked = []

    def embed(self, texts):
        self.asked.append([len(t) for t in texts])
        if len(self.asked) == 2:
            raise models.RateLimited("Rate limit reached. Limit: 1000, try again in 1.5s")
        if any(len(t) > 300 for t in texts):
            raise models.TooLong("input length exceeds")
        return [[float(len(t)), 0.0] for t in texts]


def test_embedders_learn_limits_and_shorten_inputs(spark):
    now, pauses = [0.0], []
    strict = Strict()
    paced = models.Paced(strict, 10_000, clock=lambda: now[0], sleep=lambda s: (pauses.append(s), now.__setitem__(0, now[0] + s)))
    assert paced.embed(["a" * 100]) == [[100.0, 0.0]] and paced.budget.budget == 10_000
    assert paced.embed(["b" * 200] * 2) == [[200.0, 0.0]] * 2 and paced.budget.budget == 900 and 1.5 in pauses
    assert paced.embed(["c" * 100, "d" * 900, "e" * 50]) == [[100.0, 0.0], [256.0, 0.0], [50.0, 0.0]]
    assert max(pauses) > 30, "the learned budget held later requests back"
    with pytest.raises(models.TooLong):
        models.Paced(Strict(), least_chars=400, clock=itertools.count(0, 100).__next__, sleep=lambda _s: None).embed(["f" * 1000])
    rows = models.embed(spark.createDataFrame([("x" * 500,), ("y",)], "content string").coalesce(1), Strict(), paced=lambda e: models.Paced(e, clock=itertools.count(0, 100).__next__, sleep=lambda _s: None)).collect()
    assert [r["embedding"][0] for r in rows] == [256.0, 1.0]
