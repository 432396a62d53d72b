"""Line deduplication by a log-template tree of fixed depth (operator 1).

A line's leaf is its token count and its first ``LEADING`` tokens, tokens with
digits taken as fields where another token is a word.  Inside a leaf that several lines share, a token at a
position is constant if a tenth of the leaf's lines have it there, else it is
a field: so lines that differ in their fields get one template, whatever order
they come in.  Nothing is parsed in sequence and no leaf is gathered: counts
are aggregated by (leaf, position, token).

Templates that recur in enough documents are dropped.  A document of which
more than half recurs is a copy of others; it lends no support, so the lines of
copied documents stay for the near-duplicate stage, and boilerplate goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import counted, materialise

SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Leading tokens of a leaf; parts of a leaf's lines that make a token constant; of a template's tokens that must be constant.
LEADING, CONSTANT, SIMILAR = 3, 0.1, 0.7


def _lines(docs: DataFrame) -> DataFrame:
    """(key, line_no, tokens, chars) of every line; key tells documents by id and text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(_key(docs).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    split = lambda line: F.array_remove(F.split(line, SEPARATORS, -1), "")
    fields = split(F.regexp_replace("line", "[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*", "<*>"))
    rows = rows.withColumn("fields", F.when(F.col("line").rlike("[0-9]"), fields))
    # a line without a constant word, like a table's row, is told by its numbers
    worded = F.exists("fields", lambda t: (t != "<*>") & t.rlike("\\p{L}"))
    return rows.select("key", "line_no", F.when(worded, F.col("fields")).otherwise(split(F.col("line"))).alias("tokens"), F.length("line").alias("chars"))


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("string"), F.coalesce(docs["text"].cast("string"), F.lit("")))


def _placed(docs: DataFrame, min_tokens: int) -> DataFrame:
    lines = _lines(docs).filter(F.size("tokens") >= min_tokens)
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING))
    return lines.withColumns({"leaf": leaf, "line": F.xxhash64("tokens")})


def recurring_lines(docs: DataFrame, min_docs: int = 10, min_tokens: int = 3, copied: float = 0.5) -> DataFrame:
    """(key, line_no) of the lines whose template recurs in ``min_docs`` documents that are not copies."""
    placed = materialise(_placed(docs, min_tokens).select("key", "line_no", "leaf", "line", F.size("tokens").alias("n"), "chars"), "lines")
    per_line = materialise(placed.select("leaf", "line", "n", "key").distinct().groupBy("leaf", "line", "n").agg(F.count("*").alias("docs")), "line_counts")

    # leaves that several different lines share, and those lines' tokens, one row a different line
    leaves = per_line.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("variants"))
    leaves = materialise(leaves.filter((F.col("leaf_docs") >= min_docs) & (F.col("variants") > 1)).select("leaf", "leaf_docs"), "leaves")
    variants = _placed(docs, max(min_tokens, LEADING + 1)).select("leaf", "line", "tokens").join(counted(leaves), "leaf")
    variants = variants.groupBy("leaf", "line", "leaf_docs").agg(F.max("tokens").alias("tokens")).join(per_line.select("leaf", "line", "docs"), ["leaf", "line"])
    tokens = materialise(variants.select("leaf", "line", "leaf_docs", "docs", F.posexplode("tokens").alias("at", "token")).filter(F.col("at") >= LEADING), "leaf_tokens")
    common = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("c"), F.max("leaf_docs").alias("leaf_docs"))
    common = common.filter(F.col("c") >= F.greatest(F.lit(min_docs), CONSTANT * F.col("leaf_docs"))).select("leaf", "at", "token", F.lit(True).alias("constant"))
    marked = tokens.join(common, ["leaf", "at", "token"], "left")
    shape = marked.groupBy("leaf", "line").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("constant"), F.col("token")).alias("token")))).alias("shape"), (F.count_if("constant") + LEADING).alias("fixed"), (F.count("*") + LEADING).alias("n")
    )
    templates = shape.filter((F.col("fixed") >= SIMILAR * F.col("n")) & (F.col("fixed") < F.col("n"))).select("line", F.xxhash64("leaf", "shape").alias("template"))
    templates = materialise(templates, "templates")

    rows = placed.join(counted(templates), "line", "left").select("key", "line_no", "chars", F.coalesce("template", "line").alias("template"))
    rows = materialise(rows, "template_lines")
    support = lambda lines: lines.select("template", "key").distinct().groupBy("template").count().filter(F.col("count") >= min_docs).select("template")
    recurring = materialise(support(rows), "recurring")
    found = materialise(rows.join(counted(recurring), "template", "left_semi"), "recurring_lines")

    # lines too short for a template count as a document's own
    sizes = docs.select(_key(docs).alias("key"), F.length("text").alias("total")).distinct()
    share = found.groupBy("key").agg(F.sum("chars").alias("chars")).join(sizes, "key")
    copies = materialise(share.filter(F.col("chars") > copied * F.col("total")).select("key"), "copies")
    real = materialise(support(found.join(counted(copies), "key", "left_anti")), "boilerplate")
    return found.join(counted(real), "template", "left_semi").select("key", "line_no")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, min_tokens: int = 3, copied: float = 0.5) -> DataFrame:
    """``docs`` with its columns, the recurring lines taken out of text, and n_lines, n_dropped.

    docs: a table with doc_id and text; other columns pass through (n_lines
    and n_dropped of the input are replaced).  A null text stays null with 0
    lines; a text without a recurring line stays as it is, to the byte; a
    document may end empty.  Lines of fewer than ``min_tokens`` tokens stay.
    Repeated rows are treated alike and count as one document.
    """
    drops = recurring_lines(docs, min_docs, min_tokens, copied).groupBy("key").agg(F.collect_set("line_no").alias("__drop"))
    drops = materialise(drops, "drops")
    keyed = docs.withColumn("__key", _key(docs)).join(counted(drops.withColumnRenamed("key", "__key"), 4 * F.size("__drop")), "__key", "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("__drop", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("__drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    sizes = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return keyed.select(*[F.col(f"`{c}`") for c in columns], text.alias("text"), *sizes)
