"""Set-similarity self-join of documents by parity sketches (operator 3).

A document is its set of distinct word shingles.  A parity sketch XORs every
shingle's hash into one of ``m`` cells, so each shingle that only one of two
sets holds changes at most one cell: the number of differing cells, like the
Hamming distance of a bit sketch, is a lower bound of the symmetric
difference.  Sets that link differ in at most ``(|A| + |B|) / 7`` shingles, so
they agree in many cells (pigeonhole).  ``m`` depends on the size band; a set
sends its cells to its own band and, where a partner may be larger, to the next.

1. profiles: per document its set size, a 128-bit set signature and a bit sketch.
   Documents with equal sets are one class, represented by the smallest id.
2. cells are counted by value, before any shuffle of rows; those of several
   classes are kept.  The class of a cell that shares most (the sum of its
   cells' crowds) is paired with all others: a star, so linear in the cell's
   size, and around the text from which most others were copied.
3. pairs are pruned by the Hamming bound of the bit sketches, then verified
   exactly on the shingles of both whole texts.
4. components; then cells that still hold several components.  A class may
   skip its most crowded cells here, as many as it is sure to share with any
   partner less one.  In cells of a few members the classes outside the
   largest component are compared with all others; the classes of larger cells
   are joined by their rarest shingles under prefix and positional filters.
   Two sets that link share a cell of the one kind or lie in cells of the
   other, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import counted, materialise, small, spread_join
from .words import U, Words, mix, signed, slices, text_bytes

#: Sizes from which bands begin; each band is twice as wide as the one before.
FIRST_BAND = 128
#: Agreeing cells expected of a pair at the threshold, and of how many it is held to be sure: 9.5 standard deviations below at 256 shingles, 6.7 at 1,024, 4.8 at 32,768.
EXPECTED, SURE = 32, 6
#: Members of a cell whose pairs are all compared, which is linear in the number of cells.
FEW = 16


def _cells(band: int) -> int:
    """Cells of a band: the least ``m`` with ``m exp(-d / m) >= EXPECTED`` for the largest allowed difference ``d``."""
    if band == 0:
        return 1024
    d = 2 * (FIRST_BAND << band) / 7
    m = EXPECTED
    while m * math.exp(-d / m) < EXPECTED:
        m += 1 + m // 64
    return m


def _band(n: int) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / FIRST_BAND)))


def _bits(n: int) -> int:
    """Bits of a set's sketch, eight for each allowed difference."""
    return 1 << max(6, math.ceil(math.log2(16 * n / 7 + 1)))


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    b = _bits(len(shingles))
    return (np.bincount((shingles >> U(20)).astype(np.int64) & (b - 1), minlength=b) & 1).astype(np.uint8)


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two packed sketches; the longer one is folded, which keeps the bound."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _signature(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.full(1, len(u), U)
    return mix(np.bitwise_xor.reduce(mix(u ^ U(0x5851F42D4C957F2D)), keepdims=True) ^ mix(n)), mix(u.sum(keepdims=True) + n)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, bounds in slices(batches):
        sizes, first, second, sketches = [], [], [], []
        for s in Words(data, bounds).shingles():
            u = np.unique(s)
            sizes.append(len(u))
            a, b = _signature(u) if len(u) else (np.zeros(1, U), np.zeros(1, U))
            first.append(a)
            second.append(b)
            sketches.append(np.packbits(bit_sketch(u), bitorder="little").tobytes() if len(u) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(signed(np.concatenate(first))), pa.array(signed(np.concatenate(second))), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sketch"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each filled cell; of equal sets in one partition only the first sends its cells."""
    seen: set[int] = set()
    cells: dict[int, int] = {}
    for _, data, bounds in slices(batches):
        keys, owners, bands = [], [], []
        for s in Words(data, bounds).shingles():
            if not len(s):
                continue
            u = np.unique(s)
            own = _signature(u)[0]
            if int(own[0]) in seen:
                continue
            seen.add(int(own[0]))
            band = _band(len(u))
            for k in [band, band + 1] if 4 * len(u) // 3 > FIRST_BAND << band else [band]:
                m = cells.setdefault(k, _cells(k))
                cell = ((u >> U(32)) * U(m) >> U(32)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                at = np.flatnonzero(np.diff(cell[order], prepend=-1))
                filled = cell[order[at]].astype(U)
                keys.append(mix(np.bitwise_xor.reduceat(u[order], at)) ^ mix(filled + U((k + 1) << 32)))
                owners.append(np.repeat(own, len(at)))
                bands.append(np.full(len(at), k, np.int8))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(signed(np.concatenate(owners))), pa.array(np.concatenate(bands))], names=["key", "cls", "band"])


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.to_pydict()
        keep = [7 * hamming(s, t) <= m + n for s, t, m, n in zip(c["sketch_x"], c["sketch_p"], c["n_x"], c["n_p"])]
        yield batch.select(["x", "p"]).filter(pa.array(keep, pa.bool_()))


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)

        def of(column: pa.Array, i: int) -> np.ndarray:
            data, bounds = text_bytes(column.slice(i, 1))
            return np.unique(Words(data, bounds).shingles()[0])

        for batch in batches:
            keep, pivots = [], batch.column("p").to_pylist()
            for i, p in enumerate(pivots):
                if last[0] != p:
                    last = (p, of(batch.column("text_p"), i))
                a, b = of(batch.column("text_x"), i), last[1]
                shared = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["x", "p"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_hash, text) of the wanted hashes, one row each."""
    return documents.join(counted(wanted), "text_hash", "left_semi").groupBy("text_hash").agg(F.max("text").alias("text"))


def _links(pairs: DataFrame, classes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Of pairs of classes (x, p) those that link."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    pairs = materialise(pairs.filter("x <> p").distinct(), "pairs")
    near = spread_join(pairs, side("p"), ["p"], ["x"], size=F.octet_length("sketch_p")).join(side("x"), "x")
    near = near.filter("4 * least(n_x, n_p) >= 3 * greatest(n_x, n_p)").select("x", "p", "n_x", "n_p", "sketch_x", "sketch_p")
    near = materialise(near.mapInArrow(_within_bound, "x long, p long"), "near_pairs")
    ends = near.select(F.explode(F.array("x", "p")).alias("node")).distinct()
    ends = materialise(ends.join(classes.select("node", "text_hash"), "node"), "near_texts")
    texts = _texts(documents, ends.select("text_hash").distinct())
    texts = materialise(texts.join(ends, "text_hash").select("node", "text"), "texts")
    both = spread_join(near, texts.withColumnsRenamed({"node": "p", "text": "text_p"}), ["p"], ["x"], size=F.octet_length("text_p")).join(texts.withColumnsRenamed({"node": "x", "text": "text_x"}), "x")
    return materialise(both.select("x", "p", "text_x", "text_p").mapInArrow(_verified(percent), "x long, p long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id).

    docs: any table with doc_id and text; other columns are ignored.  A null
    or blank text has no shingles and links with nothing.  Every row is a
    document of its own: rows that repeat one come back as often, and an id
    with several texts has a row, and its own links, for each; component_id is
    the smallest id that a row's links reach.  A null doc_id stays null in both
    columns and lends no link.  ``percent``: 100 * intersection >= percent *
    union links; 75 or more, as bounds and bands are proved for it.
    """
    if percent < 75:
        raise ValueError("the sketch bounds hold from 75 percent on")
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    profiles = materialise(documents.mapInArrow(_profiles, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sketch binary"), "profiles")
    filled = profiles.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("low"), F.min("text_hash").alias("text_hash"))
    heads = materialise(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
    copied = spread_join(filled.select("doc_id", "text_hash", "set_a", "set_b"), heads.select("set_a", "set_b", "low"), ["set_a", "set_b"], ["doc_id"])
    copies = materialise(copied.filter("doc_id <> low").select("doc_id", "text_hash").distinct(), "copies")

    # sets that other texts have, too, send their cells once; where the list is long, once a partition
    alone = documents.filter("doc_id IS NOT NULL")
    alone = alone.join(F.broadcast(copies), ["doc_id", "text_hash"], "left_anti") if small(copies) else alone
    cells = alone.mapInArrow(_keys, "key long, cls long, band byte")
    crowds = cells.groupBy("key").agg(F.count("*").alias("crowd"), F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("key", "crowd")
    crowds = materialise(crowds, "crowds")
    # a class is told by half its signature here, by a node of its own from here on
    nodes = heads.select(F.col("set_a").alias("cls"), "node")
    shared = materialise(cells.join(counted(crowds), "key").distinct(), "crowded_cells")
    shared = materialise(spread_join(shared, nodes, ["cls"], ["key"]).drop("cls"), "shared_nodes")
    weights = materialise(shared.groupBy("node").agg(F.sum("crowd").alias("weight")), "weights")
    pivots = materialise(shared.join(counted(weights), "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best")).select("key", F.col("best.node").alias("pivot")), "pivots")
    shared = materialise(spread_join(shared, pivots, ["key"], ["node"]), "shared_cells")

    wanted = materialise(heads.join(counted(weights.select("node")), "node", "left_semi").select("node", "set_a", "set_b", "text_hash"), "wanted")
    classes = profiles.select(F.col("n_shingles").alias("n"), "sketch", "set_a", "set_b", "text_hash").join(counted(wanted), ["set_a", "set_b", "text_hash"])
    classes = materialise(classes.groupBy("node").agg(F.max("text_hash").alias("text_hash"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")

    links = _links(shared.select(F.col("node").alias("x"), F.col("pivot").alias("p")), classes, documents, percent)
    tree = materialise(components(links, "x", "p"), "components")
    cells = _unsettled(shared, classes, tree)
    rest = _few(cells).union(_rare(cells, classes, documents))
    more = _links(rest, classes, documents, percent)
    if not more.isEmpty():
        tree = materialise(components(links.union(more), "x", "p"), "components")

    named = heads.join(tree, "node", "left").select("set_a", "set_b", "low", F.coalesce("component", "node").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    groups = materialise(named.join(lows, "component").select("set_a", "set_b", "component_id"), "groups")
    found = spread_join(filled.select("doc_id", "n_shingles", "set_a", "set_b"), groups, ["set_a", "set_b"], ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    blank = profiles.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(blank)


def _unsettled(shared: DataFrame, classes: DataFrame, tree: DataFrame) -> DataFrame:
    """(key, node, comp, pivot, members, largest): cells of a few components each, without the crowded cells of a band that a class may skip."""
    known = classes.select("node", "n").join(tree, "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp"))
    rows = shared.join(known, "node")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("key")
    sure = F.when(F.col("band") == 0, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).otherwise(SURE)
    crowded = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("crowd"), F.desc("key")))
    kept = materialise(rows.withColumn("rank", crowded).filter(F.col("rank") >= sure).join(mixed, "key", "left_semi").select("key", "node", "comp", "pivot"), "mixed_cells")
    per = kept.groupBy("key", "comp").count()
    cells = per.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("best"), F.sum("count").alias("members"), F.count("*").alias("comps")).filter("comps > 1")
    cells = materialise(cells.select("key", F.col("best.comp").alias("largest"), "members"), "mixed_keys")
    return materialise(spread_join(kept, cells, ["key"], ["node"]), "unsettled")


def _few(cells: DataFrame) -> DataFrame:
    """All pairs of different components in cells of FEW members at most."""
    few = cells.filter(F.col("members") <= FEW)
    x = few.select("key", "pivot", "largest", F.col("node").alias("x"), F.col("comp").alias("cx")).filter("cx <> largest")
    y = few.select("key", F.col("node").alias("p"), F.col("comp").alias("cp"))
    return x.join(y, "key").filter("cx <> cp AND x <> pivot AND p <> pivot AND (cp = largest OR x > p)").select("x", "p").distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, bounds in slices(batches):
        sets = [np.unique(s) for s in Words(data, bounds).shingles()]
        sizes = np.array([len(u) for u in sets])
        rows = pa.array(np.repeat(np.arange(len(sets)), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("comp").take(rows), pa.array(np.repeat(sizes, sizes)), pa.array(signed(np.concatenate(sets)))], names=["node", "comp", "n", "shingle"])


def _rare(cells: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of different components among the classes of crowded cells, by their rarest shingles.

    A link needs 3/4 of either set in common, so its sets share a shingle among
    the rarest quarter of each (prefix filter), and from the first shared one on
    enough shingles are left in both (positional filter, in the join itself).
    Of a shingle's classes those of its largest component are not compared with
    each other, and its rows are dealt over blocks.
    """
    crowd = materialise(cells.filter(F.col("members") > FEW).select("node", "comp").distinct().join(classes.select("node", "text_hash"), "node"), "crowd")
    texts = _texts(documents, crowd.select("text_hash").distinct()).join(crowd, "text_hash").select("node", "comp", "text")
    rows = materialise(texts.mapInArrow(_shingles, "node long, comp long, n long, shingle long"), "crowd_shingles")
    often = materialise(rows.groupBy("shingle").agg(F.count("*").alias("often")), "often")
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) - 1
    rare = spread_join(rows, often, ["shingle"], ["node"]).withColumn("at", place).filter(4 * F.col("at") <= F.col("n")).filter("often > 1")
    rare = materialise(rare.select("shingle", "node", "comp", "n", (F.col("n") - F.col("at")).alias("left")), "rare_shingles")
    per = rare.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max(F.struct("count", "comp")).alias("best"), F.count("*").alias("comps"))
    largest = materialise(per.filter("comps > 1").select("shingle", F.col("best.comp").alias("largest")), "largest")
    mixed = materialise(spread_join(rare, largest, ["shingle"], ["node"]), "mixed_shingles")
    side = lambda s: mixed.select("shingle", "largest", F.col("node").alias(s), F.col("comp").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("left").alias(f"l{s}"))
    x = materialise(side("x").filter("cx <> largest").drop("largest"), "outside")
    enough = "cx <> cp AND (cp = largest OR x > p) AND 7 * least(lx, lp) >= 3 * (nx + np) AND 4 * least(nx, np) >= 3 * greatest(nx, np)"
    return spread_join(side("p"), x, ["shingle"], ["p"]).filter(enough).select("x", "p")
