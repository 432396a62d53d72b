"""Grouping folds over hot keys against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffsignal.operators import folds


def slow(rule, values):
    out, group, s, n = [], -1, 0, 0
    for x in values:
        if isinstance(rule, folds.Packs):
            new = group < 0 or s + x > rule.most or (rule.count is not None and n >= rule.count)
        elif isinstance(rule, folds.Merges):
            new = group < 0 or not ((s < rule.target or x < rule.least) and s + x <= rule.most)
        else:
            new = group < 0 or x - s > rule.span
        group, n = group + new, 1 if new else n + 1
        s = x if new else s if isinstance(rule, folds.Spans) else s + x
        out.append(group)
    return out


RULES = [folds.Packs(60), folds.Packs(60, 4), folds.Packs(0, 3), folds.Merges(5, 40, 60), folds.Merges(0, 40, 60), folds.Merges(100, 40, 60), folds.Spans(30), folds.Spans(0)]
DRAWS = [lambda r: r.randrange(20), lambda r: 7, lambda r: r.choice([0, 0, 1, 90]), lambda r: 0]


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_rules_go_on_from_any_state(rule):
    rng = random.Random(1)
    for draw in DRAWS:
        for _ in range(60):
            values = [draw(rng) for _ in range(rng.randrange(1, 40))]
            values = np.cumsum(values) if isinstance(rule, folds.Spans) else np.array(values)
            want = slow(rule, values.tolist())
            assert [i for i in range(len(values)) if i == 0 or want[i] != want[i - 1]] == folds._cut(rule, values, 0)
            # any split: the open group's state tells how many rows it still takes
            k = rng.randrange(1, len(values) + 1)
            begins = folds._cut(rule, values[:k], 0)
            j = rule.ends(rule.state(values[begins[-1] : k]), values[k:]) if k < len(values) else 0
            assert [k + i for i in folds._cut(rule, values[k:], j)] == [i for i in folds._cut(rule, values, 0) if i >= k]


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_hot_keys_in_many_ranges(spark, monkeypatch, rule):
    monkeypatch.setattr(folds, "RANGE_ROWS", 40)
    rng = random.Random(2)
    rows = []
    for key, n, draw in [("hot", 700, DRAWS[0]), ("same", 300, DRAWS[1]), (None, 150, DRAWS[2]), ("zero", 120, DRAWS[3]), *((f"k{i}", rng.randrange(1, 6), DRAWS[0]) for i in range(20))]:
        values = [draw(rng) for _ in range(n)]
        values = np.cumsum(values).tolist() if isinstance(rule, folds.Spans) else values
        rows += list(zip([key] * n, range(n), values, slow(rule, values)))
    frame = spark.createDataFrame(rows, "k string, i int, x int, want int").repartition(5)
    got = folds.grouped(frame, ["k"], ["i"], F.col("x"), rule)
    assert got.columns == ["k", "i", "x", "want", "group", "begins"]
    assert got.filter("group <> want").count() == 0 and got.count() == len(rows)
    assert got.filter("begins").count() == len({(k, w) for k, _, _, w in rows})


def test_one_key_of_many_rows(spark):
    frame = spark.range(2_000_000).select(F.lit("a").alias("k"), "id", (F.col("id") * 7919 % 23).alias("x"))
    got = folds.grouped(frame, ["k"], ["id"], F.col("x"), folds.Packs(100, 12)).cache()
    assert got.count() == 2_000_000 and got.agg(F.max("group") + 1).first()[0] == got.filter("begins").count()
    worst = got.groupBy("group").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).agg(F.max("s"), F.max("n"), F.max(F.col("b") - F.col("a") + 1 - F.col("n"))).first()
    assert worst[0] <= 100 and worst[1] <= 12 and worst[2] == 0
    sizes = [i * 7919 % 23 for i in range(3000)]
    assert [r["group"] for r in got.filter("id < 3000").orderBy("id").collect()] == slow(folds.Packs(100, 12), sizes)
    assert folds.grouped(frame.limit(0), ["k"], ["id"], F.col("x"), folds.Packs(5)).count() == 0
