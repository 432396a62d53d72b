"""Chunkers as plans: sliding windows, lines, greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import chunker_of, detect_kind, detect_language
from ..functions.text import chunk_id


def char_chunks(files: DataFrame, size: int = 1000, overlap: int = 200, content: str = "content") -> DataFrame:
    """``files`` with (ord, content) of each window of ``size`` characters; an empty or null text has none.

    The text is split once into runs of one step; a window joins the few runs
    that it spans, so the work grows with the text and not with its square.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    length, step = F.length(content), size - overlap
    n = F.when(length <= size, 1).otherwise(1 + F.ceil((length - size) / step)).cast("int")
    runs = F.regexp_extract_all(F.col(content), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    spanned = F.lit(-(-size // step))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.array_join(F.slice("__runs", i + 1, spanned), ""), 1, size))
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    rows = files.filter(F.length(content) > 0).withColumn("__runs", runs)
    return rows.select(*rest, F.posexplode(cut).alias("ord", content)).select(*[F.col(f"`{c}`") for c in files.columns], "ord")


def line_chunks(files: DataFrame, lines: int = 120, size: int = 8000, content: str = "content") -> DataFrame:
    """``files`` with (ord, content, line_start, line_end) of each run of lines, cut to ``size``; an empty text is one chunk."""
    every = F.split(F.coalesce(F.col(content), F.lit("")), "\n", -1)
    rows = files.withColumn("__lines", every)
    n = F.size("__lines")
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / lines).cast("int")), lambda i: F.struct(F.substring(F.array_join(F.slice("__lines", i * lines + 1, F.lit(lines)), "\n"), 1, size).alias(content), (i * lines + 1).alias("line_start"), F.least((i + 1) * lines, n).alias("line_end")))
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    out = rows.select(*rest, F.posexplode(runs).alias("ord", "__run"))
    return out.select(*[F.col(f"__run.`{c}`").alias(c) if c == content else F.col(f"`{c}`") for c in files.columns], "ord", "__run.line_start", "__run.line_end")


def build_chunks(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of (path, content) files by the chunker of each path, stamped with id, kind and language.

    TypeScript files are cut at statements (see ``operators.typescript``), all
    others by characters.
    """
    from .typescript import ts_chunks

    routed = files.select("path", "content").withColumn("chunker", chunker_of("path"))
    plain = char_chunks(routed.filter("chunker = 'char'"), size, overlap).select("path", "ord", "content", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.array().cast("array<string>").alias("symbols"), F.lit(None).cast("string").alias("symbol_kind"), F.lit(False).alias("exported"))
    code = ts_chunks(routed.filter("chunker = 'ts'")).select(*plain.columns)
    chunks = plain.unionByName(code)
    return chunks.withColumns({"id": chunk_id("ck", F.col("path"), F.col("ord"), F.md5("content")), "kind": detect_kind("path"), "language": detect_language("path")})


def binary_split(files: DataFrame, content: str = "bytes") -> tuple[DataFrame, DataFrame]:
    """Text files with decoded ``content``, and the rejects: those with a NUL in their first 8000 bytes."""
    binary = F.instr(F.decode(F.substring(F.col(content), 1, 8000), "ISO-8859-1"), "\0") > 0
    marked = files.withColumn("is_binary", F.coalesce(binary, F.lit(True)))
    text = F.replace(F.make_valid_utf8(F.col(content).cast("string")), F.lit("\0"), F.lit(""))
    return marked.filter(~F.col("is_binary")).withColumn("content", text).drop("is_binary", content), marked.filter("is_binary").drop("is_binary", content)


def greedy_packs(sizes: Column, most: int, count: int | None = None) -> Column:
    """For an ordered array of sizes, the pack number of each: a pack takes items while their sum and number fit; a larger item is alone.

    The fold runs inside one row, as the packs of a list depend on its order.
    """
    full = (lambda s, x: (s["n"] > 0) & ((s["sum"] + x > most) | (s["n"] >= count))) if count else (lambda s, x: (s["n"] > 0) & (s["sum"] + x > most))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("pack"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = full(s, x)
        pack = s["pack"] + F.when(new, 1).otherwise(0)
        return F.struct((F.when(new, F.lit(0).cast("bigint")).otherwise(s["sum"]) + x).cast("bigint").alias("sum"), (F.when(new, 0).otherwise(s["n"]) + 1).alias("n"), pack.alias("pack"), F.array_append(s["out"], pack).alias("out"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("bigint")), zero, step, lambda s: s["out"])


def merge_small(sizes: Column, least: int, target: int, most: int) -> Column:
    """For ordered sizes of neighbours, the merged chunk of each: a chunk grows while it is below ``target`` (or its neighbour below ``least``) and the sum stays within ``most``."""
    zero = F.struct(F.lit(-1).cast("bigint").alias("sum"), F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        joins = (s["sum"] >= 0) & ((s["sum"] < target) | (x < least)) & (s["sum"] + x <= most)
        chunk = s["chunk"] + F.when(joins, 0).otherwise(1)
        return F.struct(F.when(joins, s["sum"] + x).otherwise(x).alias("sum"), chunk.alias("chunk"), F.array_append(s["out"], chunk).alias("out"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("bigint")), zero, step, lambda s: s["out"])
