"""Queries over documents as files: paths, chunks, embeddings, prompts, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, paths, targets, text
from ..operators import chunking, context, folds, ordered, retrieval
from .registry import Registry, table

query = Registry()

# A document as a file of a repository: one expression for both engines.
PATH = """concat(source, '/', CASE doc_id % 16 WHEN 0 THEN 'src/index.ts' WHEN 1 THEN 'packages/core/dist/app.js' WHEN 2 THEN 'README.md' WHEN 3 THEN 'LICENSE-MIT.txt'
 WHEN 4 THEN 'src/__tests__/app.test.ts' WHEN 5 THEN 'config/app.yaml' WHEN 6 THEN '.eslintrc' WHEN 7 THEN 'docs/CHANGELOG_v2.md' WHEN 8 THEN 'packages/db/src/types.d.ts'
 WHEN 9 THEN 'src/main.py' WHEN 10 THEN 'lib/license-parser.ts' WHEN 11 THEN 'CODE_OF_CONDUCT.md' WHEN 12 THEN 'Dockerfile' WHEN 13 THEN 'src/support.tsx' WHEN 14 THEN 'build/out.css' ELSE 'packages/web/View.SCSS' END)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.expr(PATH).alias("path"), F.col("text").alias("content"))


def _strings(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_DENY, _STEMS, _DOCS = _strings(paths.DENY_SEGMENTS), _strings(paths.DENY_STEMS), _strings(paths.DOC_EXTENSIONS)


@query(f"""
WITH p AS (SELECT doc_id, {PATH} AS path FROM documents), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p),
b AS (SELECT *, seg[-1] AS base FROM s), e AS (SELECT *, CASE WHEN contains(base, '.') THEN lower(regexp_extract(base, '\\.([^.]*)$', 1)) ELSE '' END AS ext,
 replace(lower(CASE WHEN contains(base, '.') THEN regexp_extract(base, '^(.*)\\.[^.]*$', 1) ELSE base END), '_', '-') AS stem FROM b)
SELECT doc_id, path, NOT (list_has_any(seg, {_DENY}) OR starts_with(base, '.') OR (list_contains({_DOCS}, ext) AND len(list_filter({_STEMS}, lambda x: stem = x OR starts_with(stem, x || '-'))) > 0)) AS indexable FROM e
""")
def is_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", paths.is_indexable("path").alias("indexable"))


@query(rf"""
WITH p AS (SELECT doc_id, lower({PATH}) AS l FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(l, '(\.md|\.rst)$|readme|changelog|contributing') THEN 'doc' WHEN regexp_matches(l, '/test|__tests__|\.(spec|test)\.(ts|js)$') THEN 'test'
 WHEN regexp_matches(l, '\.(json|ya?ml|toml|ini|env)$') THEN 'config' ELSE 'code' END AS kind FROM p
""")
def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", paths.detect_kind("path").alias("kind"))


_LANGUAGES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in paths.LANGUAGES.items()) + ") AS t(ext, language)"


@query(rf"""
WITH p AS (SELECT doc_id, lower(regexp_extract({PATH}, '[^./][^/]*\.([^./]+)$', 1)) AS ext FROM documents)
SELECT doc_id, language FROM p LEFT JOIN {_LANGUAGES} USING (ext)
""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", paths.detect_language("path").alias("language"))


@query(rf"""
WITH p AS (SELECT doc_id, {PATH} AS path FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(path), '\.tsx?$') THEN 'ts' ELSE 'char' END AS chunker, regexp_matches(path, '\.(ts|tsx|mts|cts)$') AS ts_file,
 regexp_matches(path, '\.(ts|tsx|mts|cts)$') AND NOT regexp_matches(path, '\.d\.(ts|mts|cts)$') AS ts_source, regexp_matches(path, '(^|/)(__tests__|tests?)/|\.(test|spec)\.[^/]+$') AS is_test,
 list_has_any(string_split(path, '/'), ['dist', 'build', 'out', 'coverage', 'node_modules']) AS generated,
 list_has_any(string_split(path, '/'), ['dist', 'build', 'out', 'node_modules']) OR ends_with(path, '.d.ts') AS generated_type FROM p
""")
def chunker_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", paths.chunker_of("path").alias("chunker"), paths.is_ts_file("path").alias("ts_file"), paths.is_ts_source("path").alias("ts_source"), paths.is_test_file("path").alias("is_test"), paths.is_generated("path").alias("generated"), paths.is_generated_type("path").alias("generated_type"))


@query(rf"""
WITH p AS (SELECT doc_id, string_split(substr({PATH}, length(source) + 2), '/') AS s FROM documents)
SELECT doc_id, CASE WHEN list_position(s, 'packages') > 0 AND list_position(s, 'packages') < len(s) THEN 'packages/' || s[list_position(s, 'packages') + 1] ELSE s[1] END AS package FROM p
""")
def package_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.substring("path", F.length("source") + 2, F.length("path"))
    return files(spark, sf_dir).select("doc_id", paths.package_of(inner).alias("package"))


TARGET = """CASE page_id % 8 WHEN 0 THEN concat('https://github.com/own', page_id % 5, '/rep', page_id, '/pull/', page_id) WHEN 1 THEN concat('https://gitlab.com/grp/sub/proj', page_id, '/-/merge_requests/', page_id)
 WHEN 2 THEN concat('https://codeberg.org/own/rep', page_id, '/pulls/', page_id) WHEN 3 THEN concat('https://github.com/own/rep', page_id, '.git') WHEN 4 THEN concat('https://gitlab.com/grp/sub/proj', page_id, '/')
 WHEN 5 THEN concat('https://codeberg.org/own/rep', page_id) WHEN 6 THEN concat('https://github.com/own', page_id % 5, '/rep.git/pull/', page_id) ELSE url END"""


@query(rf"""
WITH p AS (SELECT page_id, {TARGET} AS t FROM pages),
h AS (SELECT *, CASE WHEN contains(t, 'github.com/') THEN 'github' WHEN contains(t, 'gitlab.com/') THEN 'gitlab' WHEN contains(t, 'codeberg.org/') THEN 'codeberg' END AS host,
 string_split(rtrim(regexp_extract(t, '(?:github\.com|gitlab\.com|codeberg\.org)/(.*)$', 1), '/'), '/') AS s FROM p),
c AS (SELECT *, CASE host WHEN 'github' THEN coalesce(list_position(s, 'pull'), 0) WHEN 'codeberg' THEN coalesce(list_position(s, 'pulls'), 0) ELSE coalesce(list_position(s, '-'), 0) END AS place FROM h),
n AS (SELECT *, CASE WHEN place > 0 THEN s[1:place - 1] ELSE s END AS names FROM c)
SELECT page_id, coalesce(host, 'filesystem') AS provider, CASE WHEN host IS NULL THEN NULL WHEN place = 0 THEN 'repo' WHEN host = 'gitlab' THEN 'mr' ELSE 'pr' END AS kind,
 CASE WHEN host IS NOT NULL THEN array_to_string(names[1:len(names) - 1], '/') END AS owner, CASE WHEN host IS NOT NULL THEN regexp_replace(names[len(names)], '\.git$', '') END AS repo,
 CASE WHEN host IS NOT NULL AND place > 0 THEN s[len(s)] END AS number FROM n
""")
def classify_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", targets.classify_target(F.expr(TARGET)).alias("t"))
    return rows.select("page_id", "t.provider", "t.kind", "t.owner", "t.repo", "t.number")


@query(f"""
WITH p AS (SELECT page_id, {TARGET} AS t FROM pages)
SELECT page_id, nullif(regexp_extract(t, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\d+)/?$', 1), '') AS owner, nullif(regexp_extract(t, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\d+)/?$', 2), '') AS repo,
 try_cast(regexp_extract(t, '^https://github\\.com/([^/]+)/([^/]+)/pull/(\\d+)/?$', 3) AS INTEGER) AS number,
 CASE WHEN regexp_matches(t, '(github|gitlab)\\.com') AND page_id % 3 > 0 THEN regexp_extract(t, '(github|gitlab)\\.com', 1) END AS reporter FROM p
""")
def parse_pull_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("t", F.expr(TARGET))
    reporter = targets.reporter_of(targets.classify_target("t")["provider"], F.col("page_id") % 3 > 0)
    return rows.withColumns({"u": targets.parse_pull_url("t"), "reporter": reporter}).select("page_id", "u.owner", "u.repo", "u.number", "reporter")


@query("""
WITH d AS (SELECT doc_id, text, length(text) AS l FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN l <= 1000 THEN 0 ELSE CAST(ceil((l - 1000) / 800.0) AS BIGINT) END)) AS ord FROM d)
SELECT doc_id, ord, length(substring(text, ord * 800 + 1, 1000)) AS n, md5(substring(text, ord * 800 + 1, 1000)) AS h FROM c
""")
def char_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.char_chunks(files(spark, sf_dir), 1000, 200).select("doc_id", "ord", F.length("content").alias("n"), F.md5("content").alias("h"))


@query("""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), c AS (SELECT *, unnest(generate_series(0, (len(s) - 1) // 120)) AS ord FROM d)
SELECT doc_id, ord, ord * 120 + 1 AS line_start, least((ord + 1) * 120, len(s)) AS line_end, md5(substring(array_to_string(s[ord * 120 + 1:ord * 120 + 120], chr(10)), 1, 8000)) AS h FROM c
""")
def line_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(files(spark, sf_dir)).select("doc_id", "ord", "line_start", "line_end", F.md5("content").alias("h"))


@query("""
WITH t AS (SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 485) || chr(10) || '// [truncated]' END AS c FROM documents)
SELECT doc_id, length(c) AS n, length(c) - length(replace(c, chr(10), '')) + 1 AS lines, md5(c) AS h FROM t
""")
def truncate_with_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = text.truncate_with_marker(F.col("content"), 500)
    return files(spark, sf_dir).select("doc_id", cut.alias("c")).select("doc_id", F.length("c").alias("n"), text.line_count(F.col("c")).alias("lines"), F.md5("c").alias("h"))


_EMBED = "list_transform(range(16), lambda i: ('0x' || substr(md5({0}), (i * 2 + 1)::int, 2))::int / 255.0::double)"
_L2 = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))"


@query(f"SELECT doc_id, round(list_sum({_EMBED.format('text')}), 6) AS s, round(({_EMBED.format('text')})[1], 6) AS first FROM documents WHERE text IS NOT NULL")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).filter("content IS NOT NULL").select("doc_id", numbers.hash_embedding(F.col("content")).alias("e"))
    return rows.select("doc_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("s"), F.round(F.col("e")[0], 6).alias("first"))


@query(f"""
WITH d AS (SELECT doc_id, text, length(text) AS l FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, ord, substring(text, ord * 800 + 1, 1000) AS content FROM (SELECT *, unnest(generate_series(0, CASE WHEN l <= 1000 THEN 0 ELSE CAST(ceil((l - 1000) / 800.0) AS BIGINT) END)) AS ord FROM d)),
v AS (SELECT doc_id, ord, {_EMBED.format('content')} AS e FROM c), q AS (SELECT item_id AS q_id, {_EMBED.format('text')} AS e FROM benchmark WHERE item_id % 50 = 0),
r AS (SELECT q_id, doc_id, ord, {_L2.format('v.e', 'q.e')} AS d FROM v, q)
SELECT q_id, k AS rank, doc_id, ord, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, concat(doc_id, ':', ord)) AS k FROM r) WHERE k <= 5
""")
def nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chunk all documents, embed the chunks, and find the five nearest of each query text."""
    chunks = chunking.char_chunks(files(spark, sf_dir), 1000, 200)
    vectors = chunks.select("doc_id", "ord", F.concat_ws(":", "doc_id", "ord").alias("id"), numbers.hash_embedding(F.col("content")).alias("embedding"))
    queries = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("q_id"), numbers.hash_embedding(F.col("text")).alias("q_embedding"))
    return retrieval.nearest(vectors, queries, 5).select("q_id", "rank", "doc_id", "ord", F.round("distance", 6).alias("distance"))


_PAIRS = f"SELECT q.vec_id AS q_id, v.vec_id, v.label, q.label AS q_label, {_L2.format('v.embedding', 'q.embedding')} AS d FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


def _knn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"), F.col("embedding").alias("q_embedding"))


@query(f"""
WITH r AS ({_PAIRS}) SELECT q_id, k AS rank, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS k FROM r WHERE label <> q_label) WHERE k <= 5
""")
def knn_l2_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.nearest(*_knn(spark, sf_dir), 5, tie="vec_id", differ=[("label", "q_label")])
    return hits.select("q_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"""
WITH r AS ({_PAIRS}), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS k FROM r) WHERE k <= 10)
SELECT q_id, k2 AS rank, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS k2 FROM w WHERE label <> q_label) WHERE k2 <= 5
""")
def knn_l2_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.nearest_then_filter(*_knn(spark, sf_dir), 5, 5, F.col("label") != F.col("q_label"), "vec_id")
    return hits.select("q_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"""
WITH r AS ({_PAIRS}) SELECT q_id, count(*) AS n, round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS k FROM r WHERE label <> q_label) WHERE k <= 12 GROUP BY q_id
""")
def nearest_distance_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.distance_range(retrieval.nearest(*_knn(spark, sf_dir), 12, tie="vec_id", differ=[("label", "q_label")]))
    return hits.select("q_id", "n", F.round("min_distance", 6).alias("min_distance"), F.round("max_distance", 6).alias("max_distance"))


_TITLE = "CASE WHEN doc_id % 3 = 0 THEN concat('Change ', doc_id) WHEN doc_id % 3 = 1 THEN '' END"


@query(f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS body, concat_ws(chr(10), 'PR title: ' || nullif({_TITLE}, ''), 'File: ' || {PATH}, 'Changes:') AS header FROM documents)
SELECT doc_id, md5(header || chr(10) || substring(body, 1, greatest(1000 - length(header) - 1, 0))) AS h FROM h
""")
def embedding_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text.embedding_query(F.col("path"), F.col("content"), title=F.expr(_TITLE), limit=1000)
    return files(spark, sf_dir).select("doc_id", F.md5(q).alias("h"))


@query(f"""
SELECT doc_id, md5(concat_ws(chr(10) || chr(10), '## PR Title' || chr(10) || nullif({_TITLE}, ''), '## Branch Name' || chr(10) || lang, '## Pull Request Diff' || chr(10) || coalesce(text, ''), '## Retrieved Repository Context' || chr(10) || source)) AS h FROM documents
""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text.review_prompt(F.col("content"), F.col("source"), title=F.expr(_TITLE), branch=F.col("lang"))
    return files(spark, sf_dir).select("doc_id", F.md5(p).alias("h"))


@query(f"SELECT doc_id, 'sg-' || substr(sha1(concat(lang, chr(0), {PATH}, chr(0), doc_id)), 1, 16) AS id FROM documents")
def chunk_id_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.chunk_id("sg", F.col("lang"), F.col("path"), F.col("doc_id")).alias("id"))


# Twenty neighbouring documents are the context of one file.
_CHUNKS = f"""SELECT concat('file', doc_id // 20) AS file, doc_id AS pos, CASE doc_id % 4 WHEN 0 THEN 'references' WHEN 1 THEN 'type-references' WHEN 2 THEN 'rag' END AS provider, {PATH} AS path,
 CASE WHEN doc_id % 8 <> 4 THEN concat('sym', doc_id % 3) END AS symbol, CASE WHEN doc_id % 5 > 0 THEN doc_id % 90 END AS line_start, CASE WHEN doc_id % 5 > 1 THEN doc_id % 90 + doc_id % 2 END AS line_end,
 CASE WHEN doc_id % 6 = 0 THEN 'test' ELSE 'code' END AS kind, coalesce(text, '') AS content, CASE WHEN doc_id % 12 = 0 THEN 3 END AS shown, CASE WHEN doc_id % 12 = 0 THEN 9 END AS total FROM documents"""


def _context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("__documents")
    rows = spark.sql(_CHUNKS.replace("doc_id // 20", "doc_id div 20").replace("FROM documents", "FROM __documents"))
    marker = F.when(F.col("shown").isNotNull(), F.struct("shown", "total"))
    return rows.withColumns({"source_kind": F.lit("file"), "symbols": F.when(F.col("symbol").isNotNull(), F.array("symbol")).otherwise(F.array().cast("array<string>")), "truncated": marker})


_BLOCK = "'// ' || path || CASE WHEN line_start IS NULL THEN '' WHEN line_end IS NULL OR line_end = line_start THEN concat(':', line_start) ELSE concat(':', line_start, '-', line_end) END || CASE WHEN kind = 'test' THEN ' (test)' ELSE '' END || chr(10) || content || chr(10) || chr(10)"
_GROUP = "SELECT file, 'references' AS section, min(pos) AS pos, coalesce(symbol, '<unknown>') AS symbol, CASE WHEN arg_min(coalesce(shown, -1), pos) >= 0 THEN concat('// ', arg_min(coalesce(total, -1), pos), ' references to ', coalesce(symbol, '<unknown>'), '; ', arg_min(coalesce(shown, -1), pos), ' shown', chr(10)) ELSE '' END || string_agg(b, '' ORDER BY pos) AS block FROM x WHERE provider = 'references' GROUP BY file, coalesce(symbol, '<unknown>')"


def _sections_sql() -> str:
    parts = [f"WITH c AS ({_CHUNKS}), x AS (SELECT *, {_BLOCK} AS b FROM c), bl AS (SELECT file, section, pos, block FROM ({_GROUP}) UNION ALL SELECT file, coalesce(provider, 'rag'), pos, b FROM x WHERE coalesce(provider, 'rag') <> 'references')", "a0 AS (SELECT DISTINCT file, '' AS acc, false AS stop FROM bl)"]
    for i, (name, title) in enumerate(text.SECTIONS.items()):
        header = f"('{title}' || chr(10) || chr(10))"
        parts.append(f"p{i} AS (SELECT file, pos, block, sum(length(block)) OVER (PARTITION BY file ORDER BY pos) AS used FROM bl WHERE section = '{name}')")
        parts.append(f"s{i} AS (SELECT p.file, string_agg(block, '' ORDER BY pos) FILTER (used <= 8000 - length(acc) - length({header})) AS body FROM p{i} p JOIN a{i} a ON a.file = p.file GROUP BY p.file)")
        parts.append(f"a{i + 1} AS (SELECT a.file, CASE WHEN a.stop OR s.file IS NULL OR s.body IS NULL THEN acc ELSE acc || {header} || s.body END AS acc, a.stop OR (s.file IS NOT NULL AND s.body IS NULL) AS stop FROM a{i} a LEFT JOIN s{i} s ON s.file = a.file)")
    return ", ".join(parts) + " SELECT file, length(acc) AS n, md5(acc) AS h FROM a3"


@query(_sections_sql())
def context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sections(_context_chunks(spark, sf_dir)).select("file", F.length("context").alias("n"), F.md5("context").alias("h"))


@query(f"WITH c AS ({_CHUNKS}), x AS (SELECT *, {_BLOCK} AS b FROM c) SELECT file, pos, symbol, md5(block) AS h FROM ({_GROUP})")
def reference_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _context_chunks(spark, sf_dir).filter("provider = 'references'")
    groups = context.reference_blocks(chunks)
    return groups.select("file", "pos", "symbol", F.md5("block").alias("h"))


@query("""
SELECT conv_id, turn, used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600
""")
def context_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.budget_prefix(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], F.length("text"), 600).select("conv_id", "turn", "used")


_FENCE = "```"
_OUTPUT = """CASE turn % 4 WHEN 0 THEN concat('Sure: @json', chr(10), '{"a": ', turn, '}', chr(10), '@ done') WHEN 1 THEN concat('x {"b": {', turn, '} } } y') WHEN 2 THEN text ELSE concat('} ', text, ' {') END""".replace("@", _FENCE)


@query(f"""
WITH o AS (SELECT conv_id, turn, {_OUTPUT} AS t FROM conversations), f AS (SELECT *, trim(regexp_extract(t, '(?is){_FENCE}(?:json)?\\s*(.*?){_FENCE}', 1), chr(10) || chr(9) || chr(13) || ' ') AS fenced, instr(t, '{{') AS a, CASE WHEN contains(t, '}}') THEN length(t) - instr(reverse(t), '}}') + 1 ELSE 0 END AS z FROM o)
SELECT conv_id, turn, md5(CASE WHEN fenced <> '' THEN fenced WHEN a > 0 AND z > 0 THEN CASE WHEN z >= a THEN substring(t, a, z - a + 1) ELSE '' END ELSE t END) AS h FROM f
""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.expr(_OUTPUT.replace("chr(10)", "char(10)")))
    return rows.select("conv_id", "turn", F.md5(text.extract_json(F.col("t"))).alias("h"))


@query("""
SELECT conv_id, string_agg(part, '|' ORDER BY turn) AS spans FROM (SELECT conv_id, turn, concat(len(regexp_extract_all(concat('see `a', turn, '` or ', role), '`[^`]+`')), ':', regexp_extract(concat('Limit ', turn + 5, ', try again in ', turn, '.5s'), 'Limit[: ]+(\\d+)', 1)) AS part FROM conversations) GROUP BY conv_id
""")
def message_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    code = text.inline_code(F.concat(F.lit("see `a"), F.col("turn").cast("string"), F.lit("` or "), F.col("role")))
    hint = text.rate_limit_hint(F.concat(F.lit("Limit "), (F.col("turn") + 5).cast("string"), F.lit(", try again in "), F.col("turn").cast("string"), F.lit(".5s")))
    part = F.concat(F.size(F.filter(code, lambda s: s.startswith("`"))).cast("string"), F.lit(":"), hint["limit"].cast("string"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "|").alias("spans"))


# Fifty neighbouring documents are one ordered list.
@query("""
WITH RECURSIVE s AS (SELECT doc_id, doc_id // 50 AS list, ceil(length(coalesce(text, '')) / 2)::BIGINT AS tokens, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents),
r AS (SELECT doc_id, list, k, tokens AS held, 1 AS n, 0 AS pack FROM s WHERE k = 1 UNION ALL
 SELECT s.doc_id, s.list, s.k, CASE WHEN r.held + s.tokens > 3000 OR r.n >= 8 THEN s.tokens ELSE r.held + s.tokens END, CASE WHEN r.held + s.tokens > 3000 OR r.n >= 8 THEN 1 ELSE r.n + 1 END, CASE WHEN r.held + s.tokens > 3000 OR r.n >= 8 THEN r.pack + 1 ELSE r.pack END
 FROM r JOIN s ON s.list = r.list AND s.k = r.k + 1)
SELECT list, doc_id, pack FROM r
""")
def greedy_pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(F.expr("doc_id div 50").alias("list"), "doc_id", numbers.estimated_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))
    lists = rows.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tokens"))).alias("m"))
    packs = lists.select("list", "m", chunking.greedy_packs(F.transform("m", lambda x: x["tokens"]), 3000, 8).alias("p"))
    return packs.select("list", F.explode(F.arrays_zip("m", "p")).alias("z")).select("list", F.col("z.m.doc_id").alias("doc_id"), F.col("z.p").alias("pack"))


@query("""
WITH RECURSIVE s AS (SELECT doc_id, doc_id // 50 AS list, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents),
r AS (SELECT doc_id, list, k, size AS held, 0 AS chunk FROM s WHERE k = 1 UNION ALL
 SELECT s.doc_id, s.list, s.k, CASE WHEN (r.held < 1500 OR s.size < 200) AND r.held + s.size <= 2000 THEN r.held + s.size ELSE s.size END, CASE WHEN (r.held < 1500 OR s.size < 200) AND r.held + s.size <= 2000 THEN r.chunk ELSE r.chunk + 1 END
 FROM r JOIN s ON s.list = r.list AND s.k = r.k + 1)
SELECT list, doc_id, chunk FROM r
""")
def merge_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(F.expr("doc_id div 50").alias("list"), "doc_id", F.length(F.coalesce("content", F.lit(""))).alias("size"))
    lists = rows.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size"))).alias("m"))
    merged = lists.select("list", "m", chunking.merge_small(F.transform("m", lambda x: x["size"]), 200, 1500, 2000).alias("c"))
    return merged.select("list", F.explode(F.arrays_zip("m", "c")).alias("z")).select("list", F.col("z.m.doc_id").alias("doc_id"), F.col("z.c").alias("chunk"))


# A source is one ordered list, whatever share of all documents it holds.
@query("""
WITH RECURSIVE s AS (SELECT doc_id, source, ceil(length(coalesce(text, '')) / 2)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT doc_id, source, k, tokens AS held, 1 AS n, 0 AS pack FROM s WHERE k = 1 UNION ALL
 SELECT s.doc_id, s.source, s.k, CASE WHEN r.held + s.tokens > 3000 OR r.n >= 8 THEN s.tokens ELSE r.held + s.tokens END, CASE WHEN r.held + s.tokens > 3000 OR r.n >= 8 THEN 1 ELSE r.n + 1 END, CASE WHEN r.held + s.tokens > 3000 OR r.n >= 8 THEN r.pack + 1 ELSE r.pack END
 FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source AND s.k = r.k + 1)
SELECT source, doc_id, pack::BIGINT AS pack FROM r
""")
def greedy_pack_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("source", "doc_id", numbers.estimated_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))
    return folds.grouped(rows, ["source"], ["doc_id"], F.col("tokens"), folds.Packs(3000, 8)).select("source", "doc_id", F.col("group").alias("pack"))


@query("""
WITH RECURSIVE s AS (SELECT doc_id, source, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT doc_id, source, k, size AS held, 0 AS chunk FROM s WHERE k = 1 UNION ALL
 SELECT s.doc_id, s.source, s.k, CASE WHEN (r.held < 1500 OR s.size < 200) AND r.held + s.size <= 2000 THEN r.held + s.size ELSE s.size END, CASE WHEN (r.held < 1500 OR s.size < 200) AND r.held + s.size <= 2000 THEN r.chunk ELSE r.chunk + 1 END
 FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source AND s.k = r.k + 1)
SELECT source, doc_id, chunk::BIGINT AS chunk FROM r
""")
def merge_small_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("source", "doc_id", F.length(F.coalesce("content", F.lit(""))).alias("size"))
    return folds.grouped(rows, ["source"], ["doc_id"], F.col("size"), folds.Merges(200, 1500, 2000)).select("source", "doc_id", F.col("group").alias("chunk"))


@query("""
SELECT source, batch, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1) // 32 + (doc_id // 1000) * 32 AS batch FROM documents) GROUP BY source, batch
""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("source", "doc_id", F.expr("doc_id div 1000").alias("block"))
    got = ordered.fixed_batches(rows, ["source", "block"], [F.col("doc_id")], 32).withColumn("batch", F.col("batch") + F.col("block") * 32)
    return got.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
