"""Context for prompts: sections in order under a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SECTIONS, context_block, reference_header

BUDGET = 8000


def _files(chunks: DataFrame) -> DataFrame:
    files = chunks.filter("source_kind = 'file'").withColumn("section", F.coalesce("provider", F.lit("rag")))
    single = context_block(F.col("path"), F.col("content"), F.col("line_start"), F.col("line_end"), F.col("kind"))
    return files.withColumns({"block": single, "symbol": F.coalesce(F.get("symbols", F.lit(0)), F.lit("<unknown>"))})


def reference_blocks(chunks: DataFrame) -> DataFrame:
    """(file, symbol, pos, block): all references to a symbol as one block, under a line that tells of those not shown.

    A symbol's references were capped when they were ranked, so a group is small.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "block", "truncated")))
    groups = _files(chunks).filter("section = 'references'").groupBy("file", "symbol").agg(members.alias("m"))
    head = F.col("m")[0]["truncated"]
    joined = F.concat(reference_header(F.col("symbol"), head["shown"], head["total"]), F.array_join(F.transform("m", lambda x: x["block"]), ""))
    return groups.select("file", "symbol", F.col("m")[0]["pos"].alias("pos"), joined.alias("block"))


def _blocks(chunks: DataFrame) -> DataFrame:
    """(file, section, pos, block): a reference block holds all chunks of its symbol, another holds one chunk."""
    groups = reference_blocks(chunks).select("file", F.lit("references").alias("section"), "pos", "block")
    return groups.unionByName(_files(chunks).filter("section <> 'references'").select("file", "section", "pos", "block"))


def sections(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(file, context): the sections of each file, titled and in order, within ``budget`` characters.

    chunks: file, pos, provider, source_kind, path, symbols, line_start,
    line_end, kind, content, truncated.  A section takes blocks while they fit
    and stops at the first that does not; if none fits, it and those after it
    are left out, while a section without chunks is passed over.
    """
    titles = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    # what no budget can hold is not collected, but its section is known to be there
    used = F.sum(F.length("block")).over(Window.partitionBy("file", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    blocks = F.array_sort(F.collect_list(F.when(F.col("used") <= budget, F.struct("pos", "block"))))
    per = _blocks(chunks).filter(F.col("section").isin(*SECTIONS)).withColumn("used", used).groupBy("file", "section").agg(F.transform(blocks, lambda b: b["block"]).alias("blocks"))
    wide = per.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("section", "blocks"))).alias("by"))
    zero = F.struct(F.lit("").alias("acc"), F.lit(False).alias("stop"))

    def section(s: Column, name: Column) -> Column:
        own, header = F.try_element_at(F.col("by"), name), F.concat(F.try_element_at(titles, name), F.lit("\n\n"))
        room = F.lit(budget) - F.length(s["acc"]) - F.length(header)
        start = F.struct(F.lit("").alias("body"), F.lit(False).alias("full"))
        take = lambda b, x: F.when(~b["full"] & (F.length(b["body"]) + F.length(x) <= room), F.struct(F.concat(b["body"], x).alias("body"), F.lit(False).alias("full"))).otherwise(F.struct(b["body"].alias("body"), F.lit(True).alias("full")))
        body = F.aggregate(F.coalesce(own, F.array().cast("array<string>")), start, take, lambda b: b["body"])
        passed = s["stop"] | own.isNull()
        empty = (room <= 0) | (body == "")
        return F.when(passed, s).when(empty, F.struct(s["acc"].alias("acc"), F.lit(True).alias("stop"))).otherwise(F.struct(F.concat(s["acc"], header, body).alias("acc"), F.lit(False).alias("stop")))

    return wide.select("file", F.aggregate(F.array(*map(F.lit, SECTIONS)), zero, section, lambda s: s["acc"]).alias("context"))


def joined_context(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every file with its context; a file without one gets the empty text."""
    return files.join(contexts, "file", "left").withColumn("context", F.coalesce("context", F.lit("")))


def in_provider_order(parts: dict[str, DataFrame]) -> DataFrame:
    """The chunks of several providers, one after the other: (file, pos, ...) with pos counted across providers."""
    out = None
    for i, (name, part) in enumerate(parts.items()):
        part = part.withColumns({"provider": F.lit(name), "__provider": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    order = Window.partitionBy("file").orderBy("__provider", "pos")
    return out.withColumn("pos", F.row_number().over(order) - 1).drop("__provider")
