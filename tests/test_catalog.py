"""Every query of the catalog with SQL gives the SQL's rows on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import assert_same

from diffsignal.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], SMALL)


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_module_lists_everything():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_vectors_are_filtered_before_the_cut_and_queries_come_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from diffsignal.operators import retrieval

    vectors = spark.range(40).select(F.col("id"), F.array(F.col("id").cast("float")).alias("embedding"))
    queries = spark.range(7).select(F.col("id").alias("q_id"), F.array(F.col("id").cast("float")).alias("q_embedding"))
    one = {(r["q_id"], r["rank"], r["id"]) for r in retrieval.nearest(vectors, queries, 3, F.col("id") % 2 == 1).collect()}
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 2)
    assert one == {(r["q_id"], r["rank"], r["id"]) for r in retrieval.nearest(vectors, queries, 3, F.col("id") % 2 == 1).collect()}
    assert {r for _, r, _ in one} == {1, 2, 3} and all(i % 2 for _, _, i in one)
