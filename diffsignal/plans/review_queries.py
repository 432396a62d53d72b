"""Queries over signals, references, runs, events and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.paths import package_of
from ..operators import events, metrics, ordered, signals, snapshots
from .registry import Registry, table

query = Registry()

# Line items as raw signals: an order is a file, a supplier's lines are one review.
_RAW = """SELECT l_suppkey AS review, l_orderkey AS file_pos, l_linenumber AS sig_pos, CASE l_linenumber % 5 WHEN 0 THEN 'nit' WHEN 1 THEN 'bug' WHEN 2 THEN 'risk' ELSE 'test' END AS type,
 CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity, round(l_discount * 12, 4) AS score, concat('f', l_partkey % 97) AS file, CAST(l_quantity AS INT) AS line, concat('m', l_partkey % 3) AS message FROM lineitem"""
_VALID = f"SELECT review, file_pos, sig_pos, concat('signal-', sig_pos) AS id, type, severity, CASE WHEN file_pos % 9 = 0 THEN 0.5 ELSE least(1.0, score) END AS confidence, file, CASE WHEN file_pos % 4 > 0 THEN line END AS line_start, message FROM ({_RAW}) WHERE type <> 'nit' AND file_pos % 50 <> 7"
_SEVERITY = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence DESC, file_pos, sig_pos"
_UNIQUE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review, file, line_start, message ORDER BY file_pos, sig_pos) AS k FROM ({_VALID}) WHERE confidence >= 0.8) WHERE k = 1"


#: Several lines of one order may have one number; among those that tie the one that stands first in the table's files goes first.
_TIES = ["place"]


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    lines.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__place")).createOrReplaceTempView("__lineitem")
    raw = spark.sql(_RAW.replace("FROM lineitem", ", __place FROM __lineitem"))
    number = F.when(F.col("file_pos") % 9 == 0, "high").otherwise(F.col("score").cast("string"))
    line = F.when(F.col("file_pos") % 4 > 0, F.col("line").cast("string")).otherwise("unknown")
    message = F.when(F.col("file_pos") % 50 == 7, "").otherwise(F.col("message"))
    none = F.lit(None).cast("string")
    raw = raw.select(F.col("__place").alias("place"), "review", "file_pos", "sig_pos", "type", "severity", number.alias("confidence"), "file", line.alias("lineStart"), none.alias("lineEnd"), message.alias("message"), none.alias("rationale"), none.alias("suggestedFix"))
    good = signals.normalise(raw.withColumn("file_pos", F.struct("review", "file_pos", "place")))
    return good.withColumns({"review": F.col("file_pos.review"), "place": F.col("file_pos.place")}).withColumn("file_pos", F.col("file_pos.file_pos"))


@query(f"SELECT review, file_pos, sig_pos, id, type, severity, round(confidence, 6) AS confidence, file, line_start, message FROM ({_VALID})")
def signals_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("review", "file_pos", "sig_pos", "id", "type", "severity", F.round("confidence", 6).alias("confidence"), "file", "line_start", "message")


@query(f"SELECT severity, type, count(*) AS n FROM ({_VALID}) WHERE confidence >= 0.8 GROUP BY severity, type")
def signals_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).filter("confidence >= 0.8").groupBy("severity", "type").agg(F.count("*").alias("n"))


@query(f"SELECT review, file, line_start, message, file_pos, sig_pos FROM ({_UNIQUE})")
def signals_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ordered.first_of(_signals(spark, sf_dir).filter("confidence >= 0.8"), ["review", "file", "line_start", "message"], [F.col("file_pos"), F.col("sig_pos"), *map(F.col, _TIES)])
    return kept.select("review", "file", "line_start", "message", "file_pos", "sig_pos")


@query(f"""
SELECT review, rank, severity, round(confidence, 6) AS confidence, file, file_pos, sig_pos, total_before_cap FROM (SELECT *, row_number() OVER (PARTITION BY review ORDER BY {_SEVERITY}) AS rank, count(*) OVER (PARTITION BY review) AS total_before_cap FROM ({_UNIQUE})) WHERE rank <= 10
""")
def signals_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = signals.finalise(_signals(spark, sf_dir), 0.8, 10, ["review"], _TIES)
    return top.select("review", "rank", "severity", F.round("confidence", 6).alias("confidence"), "file", "file_pos", "sig_pos", "total_before_cap")


@query(f"SELECT k AS rank, review, severity, file, file_pos, sig_pos, n AS total_before_cap FROM (SELECT *, row_number() OVER (ORDER BY {_SEVERITY}) AS k, count(*) OVER () AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line_start, message ORDER BY file_pos, sig_pos) AS k0 FROM ({_VALID}) WHERE confidence >= 0.8) WHERE k0 = 1)) WHERE k <= 25")
def signals_total_before_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = signals.finalise(_signals(spark, sf_dir), 0.8, 25, ties=_TIES)
    return top.select("rank", "review", "severity", "file", "file_pos", "sig_pos", "total_before_cap")


# Events as model output: the JSON names a user's file; every fifth is no JSON, every seventh has no array.
@query("""
WITH e AS (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE concat('u', user_id, ':', k, ':', event_type) END AS first FROM e
""")
def parse_model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('Here you are: ```json\n{"signals": [{"type": "bug", "severity": "low", "confidence": 0.9, "file": "u'), F.col("user_id").cast("string"), F.lit('", "lineStart": '), k, F.lit(', "message": "'), F.col("event_type"), F.lit('"}]}\n```'))
    out = F.when(F.col("event_id") % 5 == 0, "no findings").when(F.col("event_id") % 7 == 0, '{"signals": 3}').otherwise(good)
    parsed = signals.parse_output(table(spark, sf_dir, "events").select("event_id", out.alias("text")))
    s = F.get("raw", F.lit(0))
    return parsed.select("event_id", "outcome", F.concat_ws(":", s["file"], s["lineStart"], s["message"]).alias("t")).select("event_id", "outcome", F.when(F.col("outcome") == "success", F.col("t")).alias("first"))


# Line items as references: a part is a symbol, declared in a package of its own.
_REFS = """SELECT l_partkey AS symbol, l_orderkey, l_linenumber AS line, concat(CASE WHEN l_suppkey % 3 = 0 THEN 'apps/web' ELSE concat('packages/p', l_suppkey % 5) END, '/src/f', l_orderkey % 13, '.ts') AS path, concat('packages/p', l_partkey % 5, '/src/decl.ts') AS declaration, l_returnflag = 'R' AS changed FROM lineitem"""
_TIER = "CASE WHEN changed THEN 0 WHEN (CASE WHEN starts_with(path, 'packages/') THEN regexp_extract(path, '^packages/[^/]+') ELSE 'apps' END) = regexp_extract(declaration, '^packages/[^/]+') THEN 1 ELSE 2 END"


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("__lineitem")
    rows = spark.sql(_REFS.replace("FROM lineitem", "FROM __lineitem"))
    return rows.withColumn("tier", snapshots.reference_tier(F.col("path"), F.col("changed"), F.col("declaration")))


_ORDER = ["tier", "path", "line", "l_orderkey"]


@query(f"""
SELECT symbol, rank, tier, path, line, total FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tier, path, line, l_orderkey) AS rank, count(*) OVER (PARTITION BY symbol) AS total FROM (SELECT *, {_TIER} AS tier FROM ({_REFS}))) WHERE rank <= 5
""")
def rank_and_cap_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.rank_and_cap(_references(spark, sf_dir), ["symbol"], [F.col(c) for c in _ORDER], 5).select("symbol", "rank", "tier", "path", "line", "total")


@query(f"""
SELECT symbol, total, least(total, 3) AS shown, CASE WHEN total > 3 THEN concat('// ', total, ' references to s', symbol, '; 3 shown', chr(10)) ELSE '' END AS marker FROM (SELECT symbol, count(*) AS total FROM ({_REFS}) GROUP BY symbol)
""")
def truncation_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = ordered.rank_and_cap(_references(spark, sf_dir), ["symbol"], [F.col(c) for c in _ORDER], 3).filter("rank = 1")
    return capped.select("symbol", "total", "shown", text.reference_header(F.concat(F.lit("s"), F.col("symbol").cast("string")), F.col("truncated.shown"), F.col("truncated.total")).alias("marker"))


@query("""
WITH h AS (SELECT l_suppkey AS owner, concat('m', l_linenumber) AS member, CAST(count(*) % 3 AS VARCHAR) AS now FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS owner, concat('m', l_linenumber) AS member, CAST(count(*) FILTER (l_returnflag <> 'R') % 3 AS VARCHAR) AS was FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL),
i AS (SELECT l_suppkey AS owner, concat('i', l_partkey % 5) AS implementer, concat('m', l_linenumber) AS member, CAST(count(*) % 2 AS VARCHAR) AS has FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
c AS (SELECT h.* FROM h LEFT JOIN b USING (owner, member) WHERE was IS NULL OR was <> now)
SELECT owner, implementer, member, CASE WHEN has IS NULL THEN 'missing' ELSE 'drift' END AS kind FROM c JOIN (SELECT DISTINCT owner, implementer FROM i) USING (owner) LEFT JOIN i USING (owner, implementer, member) WHERE has IS NULL OR has <> now
""")
def heritage_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(spark, sf_dir)


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumns({"owner": F.col("l_suppkey"), "member": F.concat(F.lit("m"), F.col("l_linenumber").cast("string")), "implementer": F.concat(F.lit("i"), (F.col("l_partkey") % 5).cast("string"))})
    head = lines.groupBy("owner", "member").agg((F.count("*") % 3).cast("string").alias("marker"))
    base = lines.filter("l_linenumber < 7").groupBy("owner", "member").agg((F.count_if(F.col("l_returnflag") != "R") % 3).cast("string").alias("marker"))
    own = lines.filter("l_linestatus = 'F'").groupBy("owner", "implementer", "member").agg((F.count("*") % 2).cast("string").alias("marker"))
    return snapshots.heritage_breaks(head, base, own)


@query(None)
def heritage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.break_stats(_breaks(spark, sf_dir), ["owner"])


query.oracles["heritage_stats"] = f"SELECT owner, count(DISTINCT implementer) AS implementers, count(*) FILTER (kind = 'drift') AS drift, count(*) FILTER (kind = 'missing') AS missing FROM ({query.oracles['heritage_breaks'].strip()}) GROUP BY owner"


@query("""
SELECT p_partkey AS symbol, c.name, 'g' || (p_size % 4) AS head_signature, 'g' || (length(p_name) % 4) AS base_signature FROM part JOIN (SELECT DISTINCT l_partkey, 's' || (l_partkey % 10) AS name FROM lineitem WHERE l_returnflag = 'R') c ON c.l_partkey = p_partkey WHERE p_size % 4 <> length(p_name) % 4 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0
""")
def signature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    side = lambda keep, n: parts.filter(keep).select(F.col("p_partkey").alias("symbol"), F.concat(F.lit("g"), (n % 4).cast("string")).alias("signature"))
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("symbol"), F.concat(F.lit("s"), (F.col("l_partkey") % 10).cast("string")).alias("name")).distinct()
    return snapshots.signature_diff(found, side("p_partkey % 3 > 0", F.col("p_size")), side("p_partkey % 5 > 0", F.length("p_name")), ["symbol"])


@query("""
WITH m AS (SELECT s_suppkey, map_from_entries([('b' || (s_suppkey % 3), 'string'), ('a', 'number')]) AS p FROM supplier)
SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 'missing:' WHEN s_suppkey % 4 = 1 THEN 'type:T' || s_suppkey WHEN s_suppkey % 4 = 2 THEN concat('call(x):', s_suppkey, '|props{a:number;b', s_suppkey % 3, ':string}') ELSE concat('props{a:number;b', s_suppkey % 3, ':string}') END AS signature FROM supplier
""".replace("WITH m AS (SELECT s_suppkey, map_from_entries([('b' || (s_suppkey % 3), 'string'), ('a', 'number')]) AS p FROM supplier)\n", ""))
def canonical_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    props = F.when(k % 4 >= 2, F.create_map(F.concat(F.lit("b"), (k % 3).cast("string")), F.lit("string"), F.lit("a"), F.lit("number"))).otherwise(F.create_map().cast("map<string,string>"))
    calls = F.when(k % 4 == 2, F.array(F.concat(F.lit("(x):"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    shown = F.when(k % 4 == 1, F.concat(F.lit("T"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("symbol"), text.canonical_signature(calls, F.array().cast("array<string>"), props, shown).alias("signature"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey AS path, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + l_linenumber % 3 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM d WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = path AND p_size <= b AND a <= p_size + 2)
""")
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_quantity").cast("int")
    declared = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), start.alias("start_line"), (start + F.col("l_linenumber") % 3).alias("end_line"))
    hunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 2).alias("end_line"))
    return snapshots.overlapping(declared, hunks).select("l_orderkey", "l_linenumber")


@query("""
SELECT source, lang, count(*) AS n_signals, count(*) FILTER (l.doc_id IS NULL) AS hallucinated FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source, lang
""")
def hallucinated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("file"))
    return metrics.grounding(found, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file")), ["source", "lang"])


# Events as runs: a user is a scenario, an event type a model.
_RUNS = """SELECT user_id AS scenario, event_type AS model, event_id AS run, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 7 AS n_signals, CASE WHEN event_id % 9 = 0 THEN 'timeout' ELSE 'success' END AS outcome, 100 + event_id % 900 AS duration_ms,
 CASE WHEN event_id % 5 > 0 THEN event_id % 400 END AS prompt_tokens, CASE WHEN event_id % 5 > 0 THEN event_id % 70 END AS completion_tokens, CASE WHEN event_id % 5 > 0 THEN event_id % 400 + event_id % 70 END AS total_tokens FROM events"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("__events")
    return spark.sql(_RUNS.replace("FROM events", "FROM __events"))


@query("""
SELECT r_name AS scenario, n_name AS model, run FROM region, nation, (SELECT unnest([1, 2, 3]) AS run)
""")
def bench_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.matrix(table(spark, sf_dir, "region").select(F.col("r_name").alias("scenario")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("model")), 3)


_STRUCTURAL = f"SELECT scenario, model, count(*) FILTER (outcome <> 'success') AS failures, count(*) FILTER (n_signals = 0) AS empty FROM ({_RUNS}) GROUP BY ALL"
_STABILITY = f"SELECT scenario, model, avg(abs(n_signals - base)) AS variance, avg(n_signals) AS avg_signals FROM (SELECT *, first_value(n_signals) OVER (PARTITION BY scenario, model ORDER BY run) AS base FROM ({_RUNS})) GROUP BY ALL"
_TOKENS = f"SELECT scenario, model, coalesce(sum(total_tokens), 0) / greatest(count(total_tokens), 1) AS avg_total_tokens, coalesce(sum(prompt_tokens), 0) / greatest(count(total_tokens), 1) AS avg_prompt_tokens, coalesce(sum(completion_tokens), 0) / greatest(count(total_tokens), 1) AS avg_completion_tokens, CASE WHEN sum(n_signals) > 0 THEN coalesce(sum(total_tokens), 0) / sum(n_signals) ELSE 0 END AS tokens_per_signal, CASE WHEN sum(duration_ms) > 0 THEN coalesce(sum(total_tokens), 0) * 1000 / sum(duration_ms) ELSE 0 END AS tokens_per_second FROM ({_RUNS}) GROUP BY ALL"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_STRUCTURAL)
def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.structural(_runs(spark, sf_dir))


@query(f"SELECT scenario, model, round(variance, 6) AS variance, round(avg_signals, 6) AS avg_signals FROM ({_STABILITY})")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.stability(_runs(spark, sf_dir)), "variance", "avg_signals")


_TOKEN_COLUMNS = ("avg_total_tokens", "avg_prompt_tokens", "avg_completion_tokens", "tokens_per_signal", "tokens_per_second")


@query(f"SELECT scenario, model, {', '.join(f'round({c}, 6) AS {c}' for c in _TOKEN_COLUMNS)} FROM ({_TOKENS})")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.tokens(_runs(spark, sf_dir)), *_TOKEN_COLUMNS)


@query(f"SELECT scenario, model, round(avg(duration_ms), 6) AS avg_latency_ms, max(duration_ms) AS max_latency_ms FROM ({_RUNS}) GROUP BY ALL")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.latency(_runs(spark, sf_dir)), "avg_latency_ms")


@query(f"""
WITH s AS ({_STRUCTURAL}), v AS ({_STABILITY}), t AS ({_TOKENS}), n AS (SELECT scenario, model, sum(n_signals) AS total, coalesce(sum(n_signals) FILTER (run % 4 = 0), 0) AS bad FROM ({_RUNS}) GROUP BY ALL)
SELECT scenario, model, CAST(total AS BIGINT) AS total_signals, round(-5 * failures - 10 * (CASE WHEN total > 0 THEN bad / total ELSE 0 END) - variance - 0.001 * (CASE WHEN total > 0 THEN avg_total_tokens / avg_signals ELSE avg_total_tokens END) + 2 * avg_signals, 6) AS score FROM s JOIN v USING (scenario, model) JOIN t USING (scenario, model) JOIN n USING (scenario, model)
""")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    bad = runs.groupBy("scenario", "model").agg(F.coalesce(F.sum(F.when(F.col("run") % 4 == 0, F.col("n_signals"))), F.lit(0)).alias("hallucinated"))
    return _rounded(metrics.scores(runs, bad).select("scenario", "model", "total_signals", "score"), "score")


@query(f"""
WITH r AS (SELECT scenario, CAST(sum(n_signals) AS BIGINT) AS s, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS t, CAST(sum(duration_ms) AS BIGINT) AS d, count(*) FILTER (outcome <> 'success') AS h FROM ({_RUNS}) GROUP BY scenario)
SELECT scenario, s AS total_signals, round(CASE WHEN s > 0 THEN t / s ELSE t END, 6) AS tokens_per_signal, round(s * 1000 / d, 6) AS signals_per_second, round(t * 1000 / d, 6) AS tokens_per_second, round(CASE WHEN s > 0 THEN h / s ELSE 0 END, 6) AS hallucination_rate FROM r
""")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _runs(spark, sf_dir).groupBy("scenario").agg(F.sum("n_signals").alias("total_signals"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.sum("duration_ms").alias("duration_ms"), F.count_if(F.col("outcome") != "success").alias("hallucinated"))
    stats = metrics.review_stats(reviews).drop("total_tokens", "duration_ms", "hallucinated")
    return _rounded(stats, "tokens_per_signal", "signals_per_second", "tokens_per_second", "hallucination_rate")


_USAGE = f"SELECT scenario, CAST(coalesce(sum(prompt_tokens) FILTER (outcome = 'success'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens) FILTER (outcome = 'success'), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(total_tokens) FILTER (outcome = 'success'), 0) AS BIGINT) AS total_tokens, count(*) FILTER (outcome <> 'success') AS failed_files, count(*) FILTER (outcome <> 'success') = count(*) AS all_failed FROM ({_RUNS}) GROUP BY scenario"


@query(_USAGE)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.usage_totals(_runs(spark, sf_dir), ["scenario"])


@query(f"SELECT run // 3 AS review, CASE WHEN count(*) FILTER (outcome <> 'success') = count(*) THEN 'failure' ELSE 'success' END AS outcome FROM ({_RUNS.replace('event_id % 9 = 0', 'event_id % 9 < 6')}) GROUP BY ALL")
def all_failed_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumns({"outcome": F.when(F.col("run") % 9 < 6, "timeout").otherwise("success"), "review": F.expr("run div 3")})
    return signals.usage_totals(runs, ["review"]).select("review", F.when(F.col("all_failed"), "failure").otherwise("success").alias("outcome"))


@query("""
SELECT event_id, CAST(used AS BIGINT) AS used, used <= 120 OR n = 1 AS admitted FROM (SELECT event_id, sum(event_id % 50) OVER w AS used, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW))
""")
def rolling_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    spends = table(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 50)
    return ordered.trailing_sum(spends, ["user_id"], "ts", "tokens", 12 * 3600, 120).select("event_id", "used", "admitted")


@query("""
WITH RECURSIVE n AS (SELECT a.user_id, a.ts, min(b.ts) AS later FROM (SELECT DISTINCT user_id, ts FROM events) a LEFT JOIN events b ON b.user_id = a.user_id AND b.ts > a.ts + INTERVAL 6 HOUR GROUP BY ALL),
r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT n.user_id, n.later FROM r JOIN n ON n.user_id = r.user_id AND n.ts = r.ts WHERE n.later IS NOT NULL)
SELECT user_id, epoch_us(ts) AS us FROM r
""")
def delivery_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_seen(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 6 * 3600).select("user_id", F.unix_micros("ts").alias("us"))


# Events as job transitions: each user's three neighbouring events are one job.
_JOBS = "SELECT event_id // 3 AS job, event_id, epoch_us(ts) // 1000 AS moved_at, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN CASE WHEN event_id % 4 > 0 THEN 'running' ELSE 'failed' END ELSE CASE WHEN event_id % 5 > 0 THEN 'completed' ELSE 'running' END END AS state FROM events"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("__events")
    return spark.sql(_JOBS.replace("//", "div").replace("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace("FROM events", "FROM __events"))


_STATE = f"SELECT job, arg_max(state, event_id) AS state, min(moved_at) FILTER (state = 'queued') AS created_at, min(moved_at) FILTER (state = 'running') AS started_at, max(moved_at) FILTER (state IN ('completed', 'failed')) AS finished_at FROM ({_JOBS}) GROUP BY job"


@query(f"SELECT job, state, created_at, started_at, finished_at FROM ({_STATE})")
def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.job_state(_jobs(spark, sf_dir), "job", "state", F.col("event_id")).drop("duration_ms")


@query(f"SELECT job, finished_at - started_at AS duration_ms FROM ({_STATE}) WHERE started_at IS NOT NULL AND finished_at IS NOT NULL")
def job_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.job_state(_jobs(spark, sf_dir), "job", "state", F.col("event_id")).filter("duration_ms IS NOT NULL").select("job", "duration_ms")


_EVENT = "concat(CASE event_id % 3 WHEN 0 THEN 'workflow.index' WHEN 1 THEN 'workflow.review.file.review' ELSE 'llm.request' END, CASE event_id % 7 WHEN 0 THEN '.failed' WHEN 1 THEN '.started' WHEN 2 THEN '.finished' WHEN 3 THEN '.retry' WHEN 4 THEN '.truncated' WHEN 5 THEN '.progress' ELSE '.loaded' END)"


@query(f"SELECT event_id, CASE WHEN ends_with(e, '.failed') THEN 'error' WHEN contains(e, 'retry') OR contains(e, 'truncated') THEN 'warn' WHEN ends_with(e, '.started') THEN 'debug' ELSE 'info' END AS level FROM (SELECT event_id, {_EVENT} AS e FROM events)")
def event_log_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", events.log_level(F.expr(_EVENT)).alias("level"))


@query(f"""
WITH e AS (SELECT user_id, event_id, {_EVENT} AS e FROM events), m AS (SELECT user_id, event_id, regexp_extract(e, '^(?:workflow\\.)?(.*)\\.[^.]*$', 1) AS task, regexp_extract(e, '[^.]*$') AS ending FROM e)
SELECT user_id, task, CASE arg_max(ending, event_id) WHEN 'finished' THEN 'succeeded' WHEN 'failed' THEN 'failed' ELSE 'running' END AS state, count(*) AS updates FROM m WHERE ending IN ('started', 'finished', 'failed', 'progress') GROUP BY ALL
""")
def event_to_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_EVENT).alias("event"))
    return events.current_tasks(log, ["user_id"], F.col("event_id")).select("user_id", "task", "state", "updates")


@query("""
SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS iso, 1700000000 + event_id AS seconds, (epoch_ms(ts) - epoch_ms(ts - INTERVAL 90 SECOND)) AS elapsed FROM events
""")
def epoch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", numbers.iso_of_seconds(F.lit(1700000000) + F.col("event_id")).alias("iso"))
    ts = F.col("ts").cast("timestamp")
    return rows.select("event_id", "iso", numbers.seconds_of(F.col("iso")).alias("seconds"), numbers.elapsed_ms(ts - F.expr("INTERVAL 90 SECOND"), ts).alias("elapsed"))


@query(f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY {_SEVERITY}) AS rank FROM ({_UNIQUE})), s AS (SELECT review, rank, '### ' || upper(severity) || ' — ' || file || chr(10) || chr(10) || message || chr(10) || chr(10) || chr(10) || chr(10) AS part FROM t WHERE rank <= 5)
SELECT review, md5('<!-- diffsignal:review -->' || chr(10) || chr(10) || '## Review' || chr(10) || chr(10) || string_agg(part, chr(10) || '---' || chr(10) ORDER BY rank) || chr(10)) AS h FROM s GROUP BY review
""")
def comment_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = signals.finalise(_signals(spark, sf_dir), 0.8, 5, ["review"], _TIES)
    part = text.comment_section(F.col("severity"), F.col("file"), F.col("message"), F.col("rationale"), F.col("suggested_fix"))
    per = top.groupBy("review").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("m"))
    return per.select("review", F.md5(text.comment_body(F.transform("m", lambda x: x["part"]))).alias("h"))


@query(f"""
SELECT symbol, count(*) FILTER (line % 3 = 0) AS "param", count(*) FILTER (line % 3 = 1) AS "return", count(*) FILTER (line % 3 = 2) AS "field" FROM ({_REFS}) GROUP BY symbol
""")
def type_reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("line") % 3 == 0, "param").when(F.col("line") % 3 == 1, "return").otherwise("field")
    per = _references(spark, sf_dir).groupBy("symbol").agg(*[F.count_if(kind == k).alias(k) for k in ("param", "return", "field")])
    return per


@query(f"""
SELECT l_orderkey, line, md5(CASE line % 3 WHEN 0 THEN '' WHEN 1 THEN concat('// missing member: m', line, ' (added to s', symbol, ')', chr(10)) ELSE concat('// stale member: m', line, ' (shape changed on s', symbol, ')', chr(10)) END || concat('// ', CASE line % 3 WHEN 0 THEN 'parameter' WHEN 1 THEN 'return' ELSE 'field' END, ' type depends on s', symbol, chr(10))) AS h FROM ({_REFS})
""")
def reference_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.concat(F.lit("s"), F.col("symbol").cast("string"))
    one = F.array(F.struct(F.when(F.col("line") % 3 == 1, "missing").otherwise("drift").alias("kind"), F.concat(F.lit("m"), F.col("line").cast("string")).alias("member")))
    breaks = F.when(F.col("line") % 3 > 0, one)
    kind = F.when(F.col("line") % 3 == 0, "param").when(F.col("line") % 3 == 1, "return").otherwise("field")
    return _references(spark, sf_dir).select("l_orderkey", "line", F.md5(F.concat(text.break_notes(symbol, breaks), text.type_note(kind, symbol))).alias("h"))
