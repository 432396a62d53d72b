"""Host-level quality rules with an empirical beta prior (operator 2), native.

Every document is measured on its whole text.  Rule failures are counted by
host (the ``source`` column, or any expression), partially before the shuffle.
A host's raw failure rate says little when it has few documents, so the rates
of all hosts give a beta prior by their first two moments, each host's rate is
shrunk towards it, and hosts whose shrunken rate passes ``max_rate`` are
rejected.  The verdicts go back to the documents by a salted join, so a host
with a third of all rows is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import counted, materialise

SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Words of a window for repeats, and parts into which a host's rows are salted.
WINDOW, SALTS = 8, 64
RULES = ("base_failed", "symbols_failed", "lines_failed")


def measure(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """(doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of whole texts."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    host = host if host is not None else docs["source"] if "source" in docs.columns else F.lit(None)
    no_symbols = F.regexp_replace("text", "[#*$%&|<>]+", "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text"))
    rows = rows.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), F.array_remove(F.split("text", SEPARATORS, -1), "").alias("words"), lines.alias("lines"), (F.length("text") - F.length(no_symbols)).alias("n_symbols"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    rows = rows.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"),
    )
    # only texts with a repeated window sort their windows
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("windows", F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, i: (F.get("windows", i - 1)["h"] == x["h"]) | (F.get("windows", i + 1)["h"] == x["h"])
    rows = rows.withColumn("starts", F.array_sort(F.transform(F.filter("windows", lambda x, i: F.coalesce(twice(x, i), F.get("windows", i + 1)["h"] == x["h"], F.get("windows", i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    return rows.select("doc_id", "host", "text_hash", *[F.col(c).cast("long") for c in longs], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.col("n_lines").cast("long"))


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_rejected) of documents with rule columns."""
    hosts = materialise(measured.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(r).alias(r) for r in RULES]), "hosts")
    moments = hosts.agg(*[f(F.col(r) / F.col("n_docs")).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    rates = []
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        weight = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
        rates.append(((F.col(r) + m * weight) / (F.col("n_docs") + weight)).alias(f"rate_{r}"))
    scored = hosts.select("host", "n_docs", *rates)
    return scored.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def _judged(docs: DataFrame, host: Column | None, max_rate: float) -> DataFrame:
    measured = measure(docs, host)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = measured.withColumns({"base_failed": failed, "symbols_failed": 10 * F.col("n_symbols") > F.col("n_words"), "lines_failed": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")})
    measured = materialise(measured, "measured")
    rejected = host_verdicts(measured, max_rate).filter("host_rejected").select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "host_rejected")
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int"))
    joined = salted.join(rejected, ["host", "salt"], "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality(docs: DataFrame, host: Column | None = None, max_rate: float = 0.5) -> DataFrame:
    """Per document (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected).

    docs: a table with doc_id and text; source names the host unless ``host``
    does; other columns are ignored.  A null text has no words and fails; a
    null host is one host of its own; repeated rows and null ids are measured
    and counted like others.  base_failed: fewer than 20 words, or over 30 %
    of them in repeated 8-word windows.  kept: neither failed nor on a host
    whose shrunken rate of any rule (base, over 10 symbols per 100 words, over
    30 % repeated lines) passes ``max_rate``.
    """
    return _judged(docs, host, max_rate).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def keep_good(docs: DataFrame, host: Column | None = None, max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns; a verdict goes by id and text, so null ids and repeated ids are told apart."""
    gone = _judged(docs, host, max_rate).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = counted(materialise(gone.distinct(), "rejected"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")
