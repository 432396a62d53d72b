"""What a review asks before it gathers context, and the windows of long texts."""

import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from diffsignal import models
from diffsignal.operators import chunking
from diffsignal.plans import catalog, indexing, reviewing
from diffsignal.sources.diffs import parse_unified


class Told:
    def __init__(self):
        self.events = []

    def emit(self, event, **fields):
        self.events.append((event, fields))


def test_index_gate():
    told = Told()
    row = Row(embedding_provider="p", embedding_model="m", commit_sha="c1")
    assert not reviewing.index_available(None, "p", "m", "c1", told) and reviewing.index_available(row, "p", "m", "c1", told) and reviewing.index_available(row, "p", "m", "c2", told) and not reviewing.index_available(row, "p", "n", "c1", told)
    assert [e for e, _ in told.events] == ["workflow.review.context_unavailable", "workflow.review.index_outdated", "workflow.review.index_outdated"] and told.events[1][1] == {"indexed": "c1", "current": "c2"}


def test_symbol_gate(spark):
    diff = lambda path, line: parse_unified(spark.createDataFrame([(f"diff --git a/{path} b/{path}\n@@ -{line} +{line} @@\n+x\n",)], "text string"))
    tree = [("tsconfig.json", "{}"), ("a.ts", "const own = 1;\nexport function f(): void {}\n"), ("b.md", "x")]
    head = spark.createDataFrame(tree, "path string, content string")
    assert reviewing.symbols_available(diff("a.ts", 2), head, "base")
    assert not reviewing.symbols_available(diff("a.ts", 1), head, "base") and not reviewing.symbols_available(diff("b.md", 1), head, "base") and not reviewing.symbols_available(diff("gone.ts", 1), head, "base")
    assert not reviewing.symbols_available(diff("a.ts", 2), head, "unknown") and not reviewing.symbols_available(diff("a.ts", 2), head.filter("path <> 'tsconfig.json'"), "base")


def test_context_of_one_ref(spark):
    files = spark.createDataFrame([("x.txt", "alpha"), ("y.txt", "beta")], "path string, content string")
    rows = [indexing.rows_for(files.filter(f"path = '{p}'"), "local", "r", ref, models.HashEmbedder()) for p, ref in (("x.txt", "one"), ("y.txt", "two"))]
    changed = parse_unified(spark.createDataFrame([("diff --git a/q.ts b/q.ts\n@@ -1 +1 @@\n+x\n",)], "text string"))
    found = lambda ref: {r["path"] for r in reviewing.rag_context(changed, rows[0].unionByName(rows[1]), models.HashEmbedder(), "local", "r", ref=ref).collect()}
    assert (found(None), found("one"), found("none")) == ({"x.txt", "y.txt"}, {"x.txt"}, set())


def test_windows_of_texts_of_any_kind_and_length(spark):
    texts = ["", None, "a", "ab\ncd\r\n\ne", "😀é数\n" * 57, "x" * 1000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    for size, overlap in ((10, 0), (10, 3), (10, 9), (7, 5), (1000, 200)):
        got = sorted(tuple(r) for r in chunking.char_chunks(frame, size, overlap).select("i", "ord", "content").collect())
        step = size - overlap
        want = [(i, k, t[k * step : k * step + size]) for i, t in enumerate(texts) if t for k in range(1 if len(t) <= size else 1 + -(-(len(t) - size) // step))]
        assert got == sorted(want)
    seconds = []
    for n in (1_000_000, 8_000_000):
        long = spark.range(1).select(F.repeat(F.lit("é23456789 "), n // 10).alias("content"))
        began = time.perf_counter()
        assert chunking.char_chunks(long, 1000, 200).agg(F.count("*"), F.sum(F.length("content"))).first()[0] == 1 + (n - 1000) // 800 + ((n - 1000) % 800 > 0)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 25 * max(seconds[0], 0.5), "eight times the text must not take sixty-four times as long"


def test_signals_that_tie_go_in_the_order_of_the_files(spark, tmp_path):
    """Lines of one order and number are ranked as they stand in the table's files, however these are read."""
    line = lambda part, order=4: (order, part, 7, 1, 3.0, 0.1, "R")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"
    parts = [random.Random(5).sample(range(97), 40) for _ in range(2)]
    folder = tmp_path / "lineitem.parquet"
    for k, some in enumerate(parts):
        spark.createDataFrame([line(p) for p in some], names).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        folder.mkdir(exist_ok=True)
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(folder / f"part-{k}.parquet")
    # the same part in the second file is another line, message or not: the first of each file, line and message stays
    want = [f"f{p}" for p in dict.fromkeys(parts[0] + parts[1])][:10]
    with_sizes = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in with_sizes}
    try:
        for k, v in with_sizes.items():
            spark.conf.set(k, v)
        rows = catalog.QUERIES["signals_top_n"](spark, str(tmp_path)).orderBy("rank").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["file"] for r in rows] == want
