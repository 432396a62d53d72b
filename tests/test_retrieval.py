"""Blocked nearest neighbours against brute force, with ties, nulls, widths and payloads."""

import math
import random

import pytest
from pyspark.sql import functions as F

from diffsignal.operators import retrieval


def slow(vectors, queries, k, differ):
    out = []
    for q, label, e in queries:
        if e is None or not all(x is not None and math.isfinite(x) for x in e):
            continue
        near = []
        for i, own, text, v in vectors:
            if v is None or len(v) != len(e) or not all(x is not None and math.isfinite(x) for x in v) or differ and (own is None or label is None or own == label):
                continue
            s = 0.0
            for x, y in zip(v, e):
                s += (x - y) * (x - y)
            near.append((math.sqrt(s), i, text))
        out += [(q, r + 1, i, text, d) for r, (d, i, text) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.mark.parametrize("cells, most, differ", [(1 << 22, 50_000, True), (40, 3, True), (7, 50_000, False)])
def test_nearest_equals_brute_force(spark, monkeypatch, cells, most, differ):
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    rng = random.Random(cells)
    point = lambda n: [rng.choice([0.0, 0.25, 0.5, 1e6 + rng.random()]) for _ in range(n)]
    vectors = [(f"v{i:03d}", rng.choice([0, 1, 2, None]), f"text {i}", point(rng.choice([3, 3, 3, 2]))) for i in range(200)]
    vectors += [("w0", 1, None, None), ("w1", 1, "x", [1.0, None, 2.0]), ("w2", 2, "y", [math.nan, 0.0, 0.0]), ("w3", 0, "z", [math.inf, 0.0, 0.0]), ("w4", 0, "e", [])]
    queries = [(i, rng.choice([0, 1, None]), point(rng.choice([3, 2]))) for i in range(9)] + [(90, 0, None), (91, 1, [math.nan] * 3), (92, 2, []), (93, 2, [0.0] * 5)]
    v = spark.createDataFrame(vectors, "id string, label int, text string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "q_id long, q_label int, q_embedding array<double>")
    hits = retrieval.nearest(v, q, 4, differ=[("label", "q_label")] if differ else ())
    assert hits.columns == ["id", "label", "text", "q_id", "q_label", "distance", "rank"]
    assert sorted((r["q_id"], r["rank"], r["id"], r["text"], r["distance"]) for r in hits.collect()) == slow(vectors, queries, 4, differ)


def test_one_scan_and_few_rows_a_task(spark, monkeypatch):
    v = spark.range(5000).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding")).repartition(4)
    q = spark.range(300).select(F.col("id").alias("q_id"), F.array(F.rand(3), F.rand(4)).alias("q_embedding"))
    hits = retrieval.nearest(v, q, 3)
    assert hits.count() == 900
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.nearest(v.limit(0), q, 3).count() == 0 and retrieval.nearest(v, q.limit(0), 3).count() == 0
