"""From model output to ranked review signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..functions.text import extract_json
from .ordered import first_of

RAW = "type string, severity string, confidence string, file string, lineStart string, lineEnd string, message string, rationale string, suggestedFix string"
TYPES, SEVERITIES = ("bug", "risk", "test"), ("low", "medium", "high")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1)


def parse_output(responses: DataFrame, text: str = "text") -> DataFrame:
    """``responses`` with outcome, error and the raw signals of the JSON in ``text``.

    The JSON must be an object with an array ``signals``; anything else is a
    failure row, and the other rows go on.
    """
    parsed = F.from_json(extract_json(F.col(text)), f"signals array<struct<{', '.join(x.replace(' ', ':') for x in RAW.split(', '))}>>", {"mode": "PERMISSIVE"})
    out = responses.withColumn("raw", parsed["signals"])
    good = F.col("raw").isNotNull()
    return out.withColumns({"outcome": F.when(good, "success").otherwise("failure"), "error": F.when(~good, "output is not an object with signals")})


def normalise(raw: DataFrame) -> DataFrame:
    """Signals of (file_pos, sig_pos, raw fields): invalid ones dropped, confidence clamped to 0..1 and 0.5 where it is no number, other lines null.

    The id tells the position before any was dropped.
    """
    number = F.col("confidence").try_cast("double")
    line = lambda c: F.when(F.col(c).try_cast("double").isNotNull(), F.col(c).try_cast("double").cast("int"))
    valid = F.col("type").isin(*TYPES) & F.col("severity").isin(*SEVERITIES) & (F.coalesce("file", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != "")
    return raw.filter(valid).select(
        "file_pos", "sig_pos", F.concat(F.lit("signal-"), F.col("sig_pos").cast("string")).alias("id"), "type", "severity", F.coalesce(clamp(number), F.lit(0.5)).alias("confidence"), "file",
        line("lineStart").alias("line_start"), line("lineEnd").alias("line_end"), "message", "rationale", F.col("suggestedFix").alias("suggested_fix"), F.lit("llm").alias("source"),
    )


def explode_raw(parsed: DataFrame, file_pos: str = "file_pos") -> DataFrame:
    """One row for each raw signal with its file's position and its own."""
    return parsed.filter(F.col("raw").isNotNull()).select(F.col(file_pos).alias("file_pos"), F.posexplode("raw").alias("sig_pos", "s")).select("file_pos", "sig_pos", "s.*")


def finalise(signals: DataFrame, threshold: float = 0.8, top: int | None = None, keys: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Confident signals, the first of each (file, line, message), ranked by severity, confidence and position, capped at ``top``.

    keys: what one review is (none: the whole table, whose rank then is one
    ordered list).  ties: what orders signals of one position, which else are
    taken as they come.  total_before_cap counts what the cap saw.
    """
    keys = keys or []
    position = [F.col("file_pos"), F.col("sig_pos"), *map(F.col, ties or [])]
    unique = first_of(signals.filter(F.col("confidence") >= threshold), [*keys, "file", "line_start", "message"], position)
    order = [severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), *position]
    if keys:
        by = Window.partitionBy(*keys)
        ranked = unique.withColumns({"rank": F.row_number().over(by.orderBy(*order)), "total_before_cap": F.count("*").over(by)})
        return ranked.filter(F.col("rank") <= top) if top else ranked
    total = unique.agg(F.count("*").alias("total_before_cap"))
    best = unique.orderBy(*order).limit(top) if top else unique
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if top else best.withColumn("rank", F.lit(None).cast("int"))
    return ranked.crossJoin(F.broadcast(total))  # one row


def usage_totals(results: DataFrame, keys: list[str]) -> DataFrame:
    """Token sums over successful files (null as 0), failures, and whether every file failed."""
    won = F.col("outcome") == "success"
    token = lambda c: F.sum(F.when(won, F.coalesce(F.col(c), F.lit(0))).otherwise(0)).alias(c)
    return results.groupBy(*keys).agg(token("prompt_tokens"), token("completion_tokens"), token("total_tokens"), F.count_if(~won).alias("failed_files"), (F.count_if(~won) == F.count("*")).alias("all_failed"))
