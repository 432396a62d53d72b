"""The pipeline's stages, each on what the one before kept, against the operators' own decisions."""

import pytest
from conftest import SMALL

import corpus_pipeline
from diffsignal.llm.decontamination import leaks
from diffsignal.llm.near_duplicates import near_duplicates
from diffsignal.llm.quality import quality
from diffsignal.llm.store import materialise


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialise(f(spark, out[-1], SMALL), name))
    return out


def test_columns_and_rows_shrink(stages):
    docs = stages[0]
    assert all(s.columns == docs.columns for s in stages[:-1])
    counts = [s.count() for s in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] and counts[-1] < counts[0]


def test_each_stage_takes_effect(spark, stages):
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(stages[1]) == ids(quality(stages[0]).filter("kept"))
    assert stages[2].filter("n_chars <> length(text)").count() == 0
    assert ids(stages[3]) == ids(near_duplicates(stages[2]).filter("n_shingles = 0 OR doc_id = component_id"))
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert ids(stages[4]) == ids(stages[3]) - ids(leaks(stages[3], bench)) and leaks(stages[4], bench).count() == 0
    assert ids(stages[5]) == ids(stages[4])


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect()))[:5] and corpus_pipeline.run(spark, SMALL).agg({"length": "sum"}).first()[0] == stages[5].agg({"length": "sum"}).first()[0]


def test_stages_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SMALL)
        assert out.count() == 0
