"""Benchmark decontamination by spaced-seed hashing (operator 7), native.

Two fixed masks of five words leave some positions out.  Together they hit any
twelve aligned words of which at most two were substituted (checked over all
placements in the tests).  Seeds of documents are joined with those of the
benchmark; a hit fixes an alignment, and the whole benchmark item is compared
along it, so what is reported has been verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import counted, materialise, spread_join

MASKS = ((0, 1, 2, 3, 5), (0, 2, 3, 6, 7))
#: A leak is a window of so many aligned words with so many equal; items under SHORT words are matched whole.
WINDOW, EQUAL, SHORT = 12, 10, 8
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NO_WORD, -1), "")


def _seeds(rows: DataFrame, key: str, place: str, short: list[int], whole: bool = False) -> DataFrame:
    """(key, place, seed) of every mask, and every run of a ``short`` length, at every word; whole: of short rows only the run that they are."""
    coded = rows.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))

    def seeds(j: int, mask: tuple[int, ...]) -> Column:
        wanted = F.size("h") > mask[-1]
        if whole:
            wanted &= (F.size("h") >= SHORT) if j < len(MASKS) else (F.size("h") == len(mask))
        starts = F.when(wanted, F.sequence(F.lit(0), F.size("h") - 1 - mask[-1])).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias(place), F.xxhash64(F.lit(j), *[F.get("h", i + o) for o in mask]).alias("seed")))

    masks = list(enumerate(MASKS)) + [(len(MASKS) + n, tuple(range(n))) for n in short]
    return coded.select(key, F.inline(F.concat(*[seeds(j, mask) for j, mask in masks])))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, item_words, first_word): the best verified alignment of each pair.

    docs: doc_id and text; benchmark: item_id and text; other columns are
    ignored.  Words are runs of letters, digits and non-ASCII characters,
    lower-cased.  A pair leaks if along one alignment some window of 12 words
    has 10 equal; an item of under 12 words must occur whole, one of under 8
    is found by a hash of all its words.  n_equal counts equal words over the
    whole item, first_word is where the item would begin in the document (ties:
    the smaller).  Null or empty texts, null ids and empty tables leak nothing;
    of an id with several texts each is searched, and the best told; an id
    with several items likewise.
    """
    items = benchmark.filter(benchmark["item_id"].isNotNull()).select(benchmark["item_id"].cast("long").alias("item_id"), _words(benchmark["text"]).alias("words"))
    items = items.filter(F.size("words") > 0).distinct().withColumns({"item": F.xxhash64("words"), "n": F.size("words")})
    items = materialise(items, "items")
    texts_of_items = materialise(items.select("item", "words", "n").dropDuplicates(["item"]), "item_texts")
    short = sorted(r["n"] for r in texts_of_items.filter(F.col("n") < SHORT).select("n").distinct().collect())
    known = materialise(_seeds(texts_of_items, "item", "item_at", short, True).distinct(), "item_seeds")
    rows = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    split = rows.select("text_hash", _words(F.col("text")).alias("words"))
    hits = _seeds(split, "text_hash", "doc_at", short).join(counted(known), "seed")
    hits = materialise(hits.select("text_hash", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    hashes = materialise(hits.select("text_hash").distinct(), "hit_texts")

    held = rows.join(counted(hashes), "text_hash", "left_semi")
    ids = materialise(held.select("doc_id", "text_hash").distinct(), "hit_ids")
    texts = held.groupBy("text_hash").agg(F.max("text").alias("text")).select("text_hash", _words(F.col("text")).alias("doc_words"))
    lengths = counted(texts_of_items.select("item", "n"))
    begin, end = F.greatest(F.col("shift"), F.lit(0)), F.least(F.col("shift") + F.col("n"), F.size("doc_words"))
    # only the words that an alignment compares go on
    parts = hits.join(lengths, "item").join(texts, "text_hash").select("text_hash", "item", "shift", "n", F.when(end > begin, F.slice("doc_words", begin + 1, end - begin)).alias("part"))
    bytes_of = F.aggregate("words", F.lit(0), lambda a, w: a + F.octet_length(w) + 16)
    pairs = parts.join(counted(texts_of_items.drop("n"), bytes_of), "item")
    lead = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.transform("words", lambda w, i: F.when((i >= lead) & (F.get("part", i - lead) == w), 1).otherwise(0))
    pairs = materialise(pairs.select("text_hash", "item", "shift", "n", equal.alias("equal")), "aligned")
    width = F.least(F.lit(WINDOW), F.col("n"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda s: F.aggregate(F.slice("equal", s, width), F.lit(0), lambda a, x: a + x)))
    total = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    found = pairs.filter(best >= F.when(F.col("n") >= WINDOW, EQUAL).otherwise(F.col("n"))).select("text_hash", "item", F.struct(total.alias("e"), (-F.col("shift")).alias("s")).alias("k"), "n")
    found = materialise(found.groupBy("text_hash", "item", "n").agg(F.max("k").alias("k")), "leaking_texts")
    named = spread_join(materialise(spread_join(found, items.select("item", "item_id"), ["item"], ["text_hash"]), "leaking_items"), ids, ["text_hash"], ["item_id"])
    named = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("k", "n")).alias("b"))
    return named.select("doc_id", "item_id", F.col("b.k.e").cast("long").alias("n_equal"), F.col("b.n").cast("long").alias("item_words"), (-F.col("b.k.s")).cast("long").alias("first_word"))
