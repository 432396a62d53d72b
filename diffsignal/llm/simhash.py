"""SimHash near-duplicates by covering locality-sensitive hashing (operator 11).

A fingerprint has a bit for each of 64 positions, set where over half of a
text's shingle hashes set it.  For a radius ``r`` every position gets a nonzero
vector of ``r + 1`` bits, and there is a mask for each nonzero vector ``v`` of
that length: it keeps the positions whose vector has an odd product with ``v``.
The vectors of ``r`` differing positions span at most ``r`` of ``r + 1``
dimensions, so some ``v`` is orthogonal to all of them and its mask hides every
difference: each pair within the radius shares a bucket of some table, with
certainty and not in expectation (for ``r = 2`` seven tables, each of 36 or 37
kept positions).

Equal fingerprints are one row.  A bucket of more than FEW fingerprints is
covered again: the same construction over the positions that its mask hides
splits it into smaller ones, and no pair is lost.  A bucket of the last level
hides so few positions that it cannot hold more than FEW different
fingerprints.  So no bucket is cut short and none is compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialise, spread_join

BITS = 64
#: Fingerprints of a bucket that are compared with each other; larger ones are covered again.
FEW = 64
#: Bytes of a text whose words are in memory at once; bounds memory, never what is read.
PIECE = 1 << 20
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some of them at a time; bytes split and lower-case at ASCII alone."""
    a = 0
    while a < len(data):
        cut = _SEPARATOR.search(data, a + PIECE)
        b = cut.start() if cut else len(data)
        yield data[a:b].lower().split()
        a = b


def fingerprint(data: bytes, k: int = 3) -> int:
    """The SimHash of a text's ``k``-word shingles, repeats included; of a shorter text that of all its words, of none zero."""
    ones, n, carry = np.zeros(BITS, np.int64), 0, []

    def add(shingles: list[bytes]) -> int:
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
        ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return len(shingles)

    for found in _pieces(data):
        words = carry + found
        if len(words) >= k:
            n += add([b" ".join(s) for s in zip(*(words[j:] for j in range(k)))])
        carry = words[-(k - 1) :] if k > 1 else []
    if not n and carry:
        n = add([b" ".join(carry)])
    return int((1 << np.flatnonzero(2 * ones > n).astype(object)).sum()) if n else 0


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``, one of which hides all differences of any two values that differ in ``radius`` of them at most."""
    vectors = range(1, 1 << (radius + 1))
    given = {p: vectors[i % len(vectors)] for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in given.items() if (m & v).bit_count() % 2) for v in vectors]


def mask_levels(radius: int) -> list[list[int]]:
    """Kept positions by level and table: those of table ``t`` are split by tables ``t * n .. t * n + n - 1`` of the next level."""
    levels, whole = [covering_masks(list(range(BITS)), radius)], (1 << BITS) - 1
    while 1 << max((whole & ~m).bit_count() for m in levels[-1]) > FEW:
        levels.append([m | s for m in levels[-1] for s in covering_masks([p for p in range(BITS) if not m >> p & 1], radius)])
    return levels


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = pa.array([_signed(fingerprint(t.as_py() or b"", k)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], names=["doc_id", "fp"])

    return run


def _tables(open_: DataFrame, masks: list[int], fan: int) -> DataFrame:
    """(t, key, fp): the rows of ``open_`` (t: their bucket's table on the level before) in each of the ``fan`` tables below."""
    kept = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = open_.select("fp", F.explode(F.sequence(F.col("t") * fan, F.col("t") * fan + (fan - 1))).alias("t"))
    return rows.select("t", F.col("fp").bitwiseAND(F.get(kept, F.col("t"))).alias("key"), "fp")


def links_within(prints: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs (x, y), x < y, of the distinct values of ``prints`` (one column fp) that differ in 1 to ``radius`` bits."""
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    levels, found = mask_levels(radius), None
    fan, open_ = len(levels[0]), prints.select("fp", F.lit(0).alias("t"))
    for masks in levels:
        rows = _tables(open_, masks, fan)
        buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).filter("n > 1")
        buckets = materialise(buckets, "buckets")
        pairs = buckets.filter("n = 2").select("x", "y")
        crowded = materialise(buckets.filter("n > 2").select("t", "key", "n"), "crowded")
        shared = materialise(spread_join(rows, crowded, ["t", "key"], ["fp"]), "shared")
        members = shared.filter(F.col("n") <= FEW).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
        each = members.select("m", F.posexplode("m").alias("i", "x"))
        inner = each.select("x", F.explode(F.filter(F.slice("m", F.col("i") + 2, FEW), lambda y: near(F.col("x"), y))).alias("y"))
        pairs = materialise(pairs.filter(near(F.col("x"), F.col("y"))).union(inner).distinct(), "pairs")
        found = pairs if found is None else found.union(pairs)
        open_ = materialise(shared.filter(F.col("n") > FEW).select("fp", "t").distinct(), "open")
        if open_.isEmpty():
            break
    return found.distinct()


def simhash_duplicates(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """Per document (doc_id, fingerprint, component_id).

    docs: any table with doc_id and text; other columns are ignored.  A null,
    empty or blank text has the fingerprint zero and links like any other.
    Every row is a document of its own: rows that repeat one come back as
    often, and an id with several texts has a row for each; component_id is the
    smallest id that a row's links reach.  A row with a null doc_id keeps its
    fingerprint, has a null component_id and lends no link.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialise(texts.mapInArrow(_fingerprints(k), "doc_id long, fp long"), "fingerprints")
    classes = materialise(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "classes")
    links = materialise(links_within(classes.select("fp"), radius), "links")
    tree = materialise(components(links, "x", "y"), "components")
    named = classes.join(tree, F.col("fp") == F.col("node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = named.join(lows, "component").select("fp", "component_id")
    copied = classes.filter("n > 1").join(tree, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("low").alias("component_id"))
    groups = materialise(linked.union(copied), "groups")
    out = spread_join(prints, groups, ["fp"], ["doc_id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)
