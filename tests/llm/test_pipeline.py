"""The pipeline's stages against what each has to keep, and the registered queries."""

from collections import Counter

import __spark_entry__ as entry_module
import corpus_pipeline
import pytest
from compare import differences, duckdb_on
from convoeval.llm.queries import ORACLES, QUERIES
from convoeval.llm.shared import stored, work_folder
from llm_data import linked

SF = "/root/testdata/sf0.001"


def test_names_of_queries():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duckdb_on(SF), ORACLES[name]) == []


def test_stages(spark):
    docs, folder = spark.read.parquet(f"{SF}/documents.parquet"), work_folder(spark, "pipeline-test")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF), f"{folder}/{name}")
        rows = {r["doc_id"]: r for r in before.collect()}
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after.collect()} == set(rows)
            break
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r for r in after.collect()}
        assert all(kept[k] == rows[k] for k in kept) and len(kept) == after.count()
        if name == "near_duplicates":
            expected = linked([(k, r["text"]) for k, r in rows.items()], 5, 80)
            assert set(kept) == {c for _, _, c in expected}
        else:
            assert 0.7 * len(rows) < len(kept) < len(rows)
        before = after


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(Counter((r["doc_id"], r["piece"]) for r in rows).values()) == 1


def test_quality_stages_hand_on_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clashing = {"score": "mine", "predicted": "p", "n_words": "w", "kept": "k", "posterior": "q"}
    mine = docs.withColumns({k: F.lit(v) for k, v in clashing.items()})
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, mine, SF)
        assert out.columns == mine.columns
        assert dict(out.dtypes) == dict(mine.dtypes)
        assert all(r[k] == v for r in out.collect() for k, v in clashing.items())
