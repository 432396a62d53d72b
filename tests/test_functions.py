"""Path predicates, diff parsing, prompt parts and guarded numbers on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from diffsignal.functions import numbers, paths, targets, text
from diffsignal.sources.diffs import get_with_retry, load_result, parse_unified, rebuild_unified
from diffsignal.sources.files import safe_path

INDEXABLE = {
    "src/index.ts": True, "README.md": True, "Dockerfile": True, "src/support.ts": True, "lib/license-parser.ts": True, "fixtures/license.json": True, "docs/README": True,
    "packages/core/dist/index.js": False, ".prettierrc": False, "LICENSE-MIT.txt": False, "CODE_OF_CONDUCT.md": False, "CHANGELOG_v2.md": False, "": False, "dist\\index.js": False,
    "node_modules/a.js": False, ".github/x.yml": False, "LICENSE": False, "docs/NEWS.adoc": False, "newsfeed.js": True, "src/.env": False,
}


def test_is_indexable(spark):
    df = spark.createDataFrame([(p,) for p in INDEXABLE], "path string").select("path", paths.is_indexable("path").alias("ok"))
    assert {r["path"]: r["ok"] for r in df.collect()} == INDEXABLE
    assert spark.createDataFrame([(None,)], "path string").select(paths.is_indexable("path").alias("ok")).first()["ok"] is None


@pytest.mark.parametrize("path, kind, language", [("docs/README.txt", "doc", None), ("src/a.spec.ts", "test", "typescript"), ("a/tests/x.py", "test", "python"), ("a.toml", "config", "toml"), ("Makefile", "code", None), ("a/.json", "config", None), ("A.TSX", "code", "typescript")])
def test_kind_and_language(spark, path, kind, language):
    row = spark.createDataFrame([(path,)], "path string").select(paths.detect_kind("path").alias("k"), paths.detect_language("path").alias("l"), paths.package_of("path").alias("p")).first()
    assert (row["k"], row["l"]) == (kind, language)


def test_package_and_relative(spark):
    rows = spark.createDataFrame([("packages/core/a.ts",), ("apps/web/b.ts",), ("packages",), ("x/packages/y/z",)], "path string")
    assert [r[0] for r in rows.select(paths.package_of("path")).collect()] == ["packages/core", "apps", "packages", "packages/y"]
    both = rows.select(paths.relative_to("path", "packages"), paths.relative_to("path", "packages", absolute=True)).collect()
    assert [tuple(r) for r in both] == [("core/a.ts", "core/a.ts"), (None, "apps/web/b.ts"), (None, "packages"), (None, "x/packages/y/z")]


def test_targets(spark):
    urls = ["https://github.com/a/b/pull/12", "git@github.com/a/b.git", "https://gitlab.com/g/s/p/-/merge_requests/3", "./here", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(targets.classify_target("u").alias("t")).collect()
    assert [(r["t"]["provider"], r["t"]["kind"], r["t"]["owner"], r["t"]["repo"], r["t"]["number"]) if r["t"] else None for r in got] == [
        ("github", "pr", "a", "b", "12"), ("github", "repo", "a", "b", None), ("gitlab", "mr", "g/s", "p", "3"), ("filesystem", None, None, None, None), None,
    ]
    with pytest.raises(Exception, match="no pull request"):
        spark.createDataFrame([("x",)], "u string").select(targets.parse_pull_url("u", strict=True)).collect()


DIFF = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,2 +3,4 @@ head
+one
 two
@@ -9 +12 @@
+three
diff --git a/b.md b/b.md
@@ -1,3 +1,0 @@
-gone
"""


def test_unified_diff(spark):
    rows = parse_unified(spark.createDataFrame([(7, DIFF), (8, ""), (9, "noise")], "diff_id long, text string")).orderBy("diff_id", "pos").collect()
    assert [(r["diff_id"], r["pos"], r["path"]) for r in rows] == [(7, 0, "src/a.ts"), (7, 1, "b.md"), (9, 0, "unknown")]
    assert [(h["start_line"], h["end_line"], h["content"]) for h in rows[0]["hunks"]] == [(3, 6, "+one\n two"), (12, 12, "+three")]
    assert [(h["start_line"], h["end_line"]) for h in rows[1]["hunks"]] == [(1, 1)]


def test_rebuilt_diff_parses_again(spark):
    changes = spark.createDataFrame([([("a.ts", "b.ts", "@@ -1 +1 @@\n+x")],)], "c array<struct<old_path:string,new_path:string,diff:string>>")
    assert [r["path"] for r in parse_unified(changes.select(rebuild_unified(F.col("c")).alias("text"))).collect()] == ["b.ts"]


def test_payloads_of_hosts(spark):
    rows = [("github", '{"title": "t", "body": "d", "head": {"ref": "f", "sha": "1"}, "base": {"sha": "0", "repo": {"full_name": "a/b"}}}'), ("gitlab", '{"title": "t", "description": "d", "source_branch": "f", "diff_refs": {"head_sha": "1", "base_sha": "0"}, "references": {"full": "a/b"}}')]
    for r in load_result(spark.createDataFrame(rows, "provider string, payload string")).collect():
        assert (r["title"], r["description"], r["branch"], r["revision"], r["base_revision"], r["repo_id"]) == ("t", "d", "f", "1", "0", "a/b")


def test_retry_only_on_gateway_errors():
    seen, pauses = iter([(503, ""), (502, ""), (200, "ok")]), []
    assert get_with_retry(lambda _u: next(seen), "u", pauses.append) == "ok" and pauses == [0.3, 0.6]
    with pytest.raises(OSError, match="404"):
        get_with_retry(lambda _u: (404, ""), "u", pauses.append)


def test_embedding_query_keeps_its_header(spark):
    df = spark.createDataFrame([("src/a.ts", "x" * 900, "Title"), ("b" * 90, "patch", None)], "path string, patch string, title string")
    got = [r[0] for r in df.select(text.embedding_query(F.col("path"), F.col("patch"), title=F.col("title"), limit=60)).collect()]
    assert got[0].startswith("PR title: Title\nFile: src/a.ts\nChanges:\nx") and len(got[0]) == 60
    assert got[1] == f"File: {'b' * 90}\nChanges:\n"


def test_json_and_fences(spark):
    cases = {"```JSON\n{\"a\": 1}\n```": '{"a": 1}', 'so {"a": {"b": 2}} there': '{"a": {"b": 2}}', "none": "none", "} {": "", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.extract_json(F.col("t")).alias("j")).collect()
    assert {r["t"]: r["j"] for r in got} == cases


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.ratio(F.lit(1), F.lit(0)).alias("a"), numbers.ratio(F.lit(1), F.lit(4)).alias("b"), numbers.clamp(F.lit(1.7)).alias("c"), numbers.seconds_of(F.lit("1970-01-01T00:00:01.900Z")).alias("d"),
        numbers.seconds_of(F.lit("2500")).alias("e"), numbers.l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("f"), numbers.iso_of_seconds(F.lit(0)).alias("g"), text.rate_limit_hint(F.lit("Limit 90, try again in 1.5s")).alias("h"),
    ).first()
    assert tuple(row)[:7] == (0.0, 0.25, 1.0, 1, 2, 5.0, "1970-01-01T00:00:00.000Z") and tuple(row["h"]) == (90, 1.5)


def test_paths_that_lead_out():
    assert safe_path("a/b.ts") == "a/b.ts"
    for bad in ("../x", "/etc/passwd", "a/../../b", ""):
        with pytest.raises(ValueError):
            safe_path(bad)
