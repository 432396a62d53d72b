"""SimHash duplicates, importance resampling and hard negatives against brute-force versions and awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from diffsignal.llm import hard_negatives as mining
from diffsignal.llm import resampling, simhash
from diffsignal.llm.hard_negatives import hard_negatives
from diffsignal.llm.resampling import resample
from diffsignal.llm.simhash import simhash_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: {doc_id: fingerprint}; the smallest id that each can reach over pairs at two bits or fewer."""
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in prints}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = {r.doc_id: slow_print(r.text) for r in docs.collect()}
    want = slow_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_duplicates(docs).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_of_the_radius(radius):
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(30 <= m.bit_count() <= 44 for m in masks)
    for differing in itertools.combinations(range(64), radius):
        assert any(not any(m >> p & 1 for p in differing) for m in masks)


def test_last_level_of_masks_bounds_its_buckets():
    levels = simhash.mask_levels(2)
    assert [len(m) for m in levels] == [7, 49, 343]
    assert max(2 ** (64 - m.bit_count()) for m in levels[-1]) <= simhash.FEW
    for t, mask in enumerate(levels[1]):
        assert levels[0][t // 7] & mask == levels[0][t // 7]


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5]))) for _ in range(1500)} | {0, (1 << 64) - 1}
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2}
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long").repartition(3)
    got = [tuple(r) for r in simhash.links_within(frame, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_pieces_of_long_texts_join_up(monkeypatch):
    text = " ".join(f"W{i % 97}\t{i % 13}\n" for i in range(3000)).encode()
    whole, found = simhash.fingerprint(text), list(resampling.features(text))
    monkeypatch.setattr(simhash, "PIECE", 50)
    monkeypatch.setattr(resampling, "PIECE", 50)
    assert simhash.fingerprint(text) == whole == slow_print(text.decode())
    parts = list(resampling.features(text))
    assert len(parts) > 100 and sum(n for n, _ in parts) == sum(n for n, _ in found) == 6000
    assert sorted(np.concatenate([f for _, f in parts])) == sorted(np.concatenate([f for _, f in found]))


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (4, "other words of the same id, ten or twenty of them, to be told apart from the first " * 2), (5, "ONE two"), (None, "one two"), (None, None), (6, "x y " * 40_000), (7, "Ünï 数字 😀 " * 9)]
CLASHING = ["fp", "t", "key", "n", "low", "m", "node", "component", "score", "uid", "rank", "range", "weight", "bucket", "eligible", "component_id"]


def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(2)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def test_simhash_of_awkward_rows(spark):
    rows = simhash_duplicates(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in zero) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    two = f"{slow_print('one two'):016x}"
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows if r.fingerprint == two) == [(0, 0), (4, 4), (4, 4), (5, 4)]
    assert simhash_duplicates(awkward(spark).limit(0)).collect() == []


def slow_resample(docs, target, percent, min_words):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:]))]]

    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, text in docs:
        np.add.at(s, features(text)[1], 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10_000) / ((x + 1) * (t.sum() + 10_000)))) for x, y in zip(s.tolist(), t.tolist())]
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if i is not None else None))
    able = sorted((-r[4], r[0]) for r in rows if r[0] is not None and r[1] >= min_words)
    rank = {k: i + 1 for i, k in enumerate(able[: percent * len(able) // 100])}
    return sorted((r[0] or 0, r[2], r[3], r[4], rank.get((-(r[4] or 0), r[0]))) for r in rows)


@pytest.mark.parametrize("cell, rows", [(1024, 500_000), (3, 7)])
def test_resampling_equals_brute_force(spark, monkeypatch, cell, rows):
    monkeypatch.setattr(resampling, "CELL", cell)
    monkeypatch.setattr(resampling, "RANGE_ROWS", rows)
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = slow_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 40, 10)
    got = sorted(tuple(r) for r in resample(docs, target, percent=40, min_words=10).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and got == want


def test_resampling_of_awkward_rows(spark):
    target = spark.createDataFrame([(None,), ("one two three",)], "text string")
    rows = resample(awkward(spark), target, percent=100).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.score for r in rows if r.doc_id is None} == {None}
    assert sorted(r.rank for r in rows if r.rank) == [1, 2, 3]
    assert {(r.n_features, r.weight) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert resample(awkward(spark).limit(0), target).collect() == []
    assert len(resample(awkward(spark), target.limit(0)).collect()) == len(AWKWARD)
    same = spark.createDataFrame([(9, "a b c " * 10)] * 40, "doc_id long, text string").repartition(4)
    ranks = [r.rank for r in resample(same, target).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 11)) and ranks.count(None) == 30


def test_tournament_merges_in_order():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 8, 20):
        runs = [sorted((rng.randrange(9), r, i) for i in range(rng.randrange(6))) for r in range(n)]
        tree = resampling.Tournament(runs)
        assert list(iter(tree.next, None)) == sorted(x for r in runs for x in r)


def slow_negatives(rows, every=100, k=5):
    clean = {(i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    clean = sorted((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in clean)
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), mining.LEAST), mining.MOST)
    out = []
    for i, label, v in clean:
        if i % every:
            continue
        others = sorted(((-score(v, w), j, m) for j, m, w in clean))
        for s, j, _ in [o for o in others if o[2] == label and o[1] != i][:5]:
            inside = [(t, n) for t, n, m in others if m != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside[:k])]
    return sorted(out)


def vectors(rng, n, wide=1.0):
    return [(i, rng.randrange(4), [rng.gauss(0, 1) * wide ** rng.random() for _ in range(6)]) for i in range(n)]


@pytest.mark.parametrize("wide, block", [(1.0, 1 << 20), (50.0, 900), (1e7, 900), (1e12, 2000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, wide, block):
    monkeypatch.setattr(mining, "BLOCK_BYTES", block)
    rows = vectors(random.Random(int(wide)), 300, wide)
    rows += [(1000 + i, label, list(v)) for i, label, v in rows[:40]]  # ties
    rows += [(2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, [1.0, None] * 3), (2003, 1, [math.nan] * 6), (2004, 1, [math.inf] * 6), (None, 1, [1.0] * 6), (2100, 2, []), (2200, 2, [1.0] * 3), (2205, 3, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).withColumns({c: F.lit(1) for c in ("score", "query", "id", "norm", "rank", "top")})
    got = sorted(tuple(r) for r in hard_negatives(frame, every=20).collect())
    assert got == slow_negatives(rows, every=20) and len(got) > 50


def test_buckets_are_pruned_by_their_norm():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)) * (1 + 9 * (np.arange(400) < 40))[:, None]
    m = np.floor(256 * v).astype(np.int64)
    q = mining.Queries(np.arange(5), np.zeros(5, np.int64), m[:5], np.arange(5), np.full(5, mining.LEAST), np.full(5, mining.MOST), np.full(5, mining.LEAST), True)
    best, norms, looked = mining.Best(5, 5), mining._norms(m[:5]), []
    for a in range(0, 400, 40):
        part = m[a : a + 40]
        looked.append(q.search(best, norms, float(mining._norms(part).max()), np.arange(a, a + 40), np.zeros(40, np.int64), part))
    assert looked[0] and not any(looked[1:])


def test_hard_negatives_of_no_rows_and_of_many_rounds(spark, monkeypatch):
    rows = vectors(random.Random(8), 120)
    frame = spark.createDataFrame(rows + rows[:30], "vec_id int, label int, embedding array<double>")
    assert hard_negatives(frame.limit(0)).collect() == [] and hard_negatives(frame.filter("vec_id % 20 <> 0"), every=20).collect() == []
    monkeypatch.setattr(mining, "ROUND_BYTES", 300)
    assert sorted(tuple(r) for r in hard_negatives(frame, every=20).collect()) == slow_negatives(rows, every=20)
