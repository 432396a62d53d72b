"""Hilbert-curve sharding by document metadata (operator 5).

Source, language and size are quantised to four bits each by rank, so that a
cell is a range of names and of sizes with about as many documents as others;
a document's place on the Hilbert curve through that cube orders it, so a run of the order spans
few values in every dimension and its files' statistics prune in each of them.
The order is cut into runs whose row counts differ by one at most.

The global rank needs no total sort: a grid cell is split by a hash of the id
into slices, the counts of slices and cells (at most 4,096 x 1,024 rows,
whatever the input) are summed up in curve order, and only inside a slice are
rows numbered.  A cell with a third of all rows is 1,024 groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

BITS, DIMENSIONS, SLICES = 4, 3, 1024


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """A lattice point's place on the Hilbert curve (the transpose method of Skilling, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def _curve(dims: list[Column]) -> Column:
    """The curve index of quantised dimensions, looked up in the grid's table."""
    side = 1 << BITS
    grid = [hilbert_index((i // side // side, i // side % side, i % side)) for i in range(side**DIMENSIONS)]
    cell = (dims[0] * side + dims[1]) * side + dims[2]
    return F.element_at(F.lit(grid), (cell + 1).cast("int"))


def _cuts(values: DataFrame) -> list[tuple[int, object]]:
    """Up to 16 (cell, first value) that part the rows of (value) into 16 ranges of about equal count; a frequent value spans several cells.

    Counts by value are summed up in order of value: inside range partitions,
    and over the partitions' totals, which are one row each.
    """
    counts = values.groupBy("value").agg(F.count("*").alias("n")).repartitionByRange("value")
    counts = materialise(counts.withColumn("part", F.spark_partition_id()), "value_counts")
    totals = counts.groupBy("part").agg(F.sum("n").alias("rows"))
    over = Window.orderBy("part")
    bases = totals.select("part", (F.sum("rows").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("base"), F.sum("rows").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("value")) - F.col("n")
    ranked = counts.withColumn("before", before).join(F.broadcast(bases), "part")
    cell = F.floor((F.col("base") + F.col("before")) * (1 << BITS) / F.col("total"))
    return sorted((r["cell"], r["cut"]) for r in ranked.groupBy(cell.alias("cell")).agg(F.min("value").alias("cut")).collect())


def quantised(docs: DataFrame) -> list[Column]:
    """Four bits each for source, language and size: the cell in which the value lies by rank."""
    text = lambda c: F.coalesce((docs[c] if c in docs.columns else F.lit(None)).cast("string"), F.lit(""))
    # sizes are told to a sixteenth of their binary logarithm: 1,024 values at most
    size = F.floor(F.log2((F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 1).cast("double")) * 16).cast("int")
    out = []
    for value in (text("source"), text("lang"), size):
        cuts = _cuts(docs.select(value.alias("value")))
        cell = F.lit(0)
        for number, first in cuts[1:]:
            cell = F.when(value >= F.lit(first), number).otherwise(cell)
        out.append(cell.cast("int"))
    return out


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document (doc_id, size, text_crc32, law, shard, slot, grown_shard, curve).

    docs: a table with doc_id and text; source and lang are used where there.
    size is the text's UTF-8 bytes plus one (a null text: 1, checksum 0).
    law is "rows": shards' row counts differ by one at most; slots count each
    shard's rows from 0 in curve order.  Repeated rows, null ids and equal
    texts are placed like others.  grown_shard is null: under this law a
    further shard moves rows between old ones.
    """
    return _ranked(docs, shards, False)


def _ranked(docs: DataFrame, shards: int, whole: bool) -> DataFrame:
    """The columns of ``hilbert_shards`` and, if ``whole``, each document as a struct ``doc``."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text_crc32"),
        _curve(quantised(docs)).cast("int").alias("curve"),
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")] if whole else []),
    )
    # null ids with one text are told apart by their place in the input
    told = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", told), F.lit(SLICES)).cast("int"))
    rows = materialise(rows, "placed")

    slices = rows.groupBy("curve", "slice").agg(F.count("*").alias("n"))
    cells = slices.groupBy("curve").agg(F.sum("n").alias("cell_n"))
    earlier = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    cells = cells.select("curve", F.coalesce(F.sum("cell_n").over(earlier), F.lit(0)).alias("cell_base"), F.sum("cell_n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), "curve")
    bases = bases.select("curve", "slice", "total", (F.col("cell_base") + F.col("before")).alias("base"))

    rank = F.row_number().over(Window.partitionBy("curve", "slice").orderBy("doc_id", "text_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(bases, ["curve", "slice"]).withColumn("g", F.col("base") + F.col("rank"))
    k = F.lit(shards)
    # the first total % k shards hold one row more
    ranked = ranked.withColumns({"q": F.floor(F.col("total") / k), "r": F.col("total") % k})
    ranked = ranked.withColumn("head", F.col("r") * (F.col("q") + 1))
    ranked = ranked.withColumn("shard", F.when(F.col("g") < F.col("head"), F.floor(F.col("g") / (F.col("q") + 1))).otherwise(F.col("r") + F.floor((F.col("g") - F.col("head")) / F.greatest(F.col("q"), F.lit(1)))))
    first = F.col("shard") * F.col("q") + F.least(F.col("shard"), F.col("r"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("g") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *(["doc"] if whole else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write whole documents as one folder a shard, rows in curve order, so file statistics prune in every dimension; a column ``shard`` of the input gives way."""
    placed = _ranked(docs, shards, True).select("shard", "slot", "doc")
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    names = [c for c in docs.columns if c != "shard"]
    ordered.select("shard", *[F.col(f"doc.`{c}`").alias(c) for c in names]).write.partitionBy("shard").parquet(path)
