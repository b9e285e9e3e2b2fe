from collections import Counter

import pytest
from convoeval.llm import rules
from llm_data import awkward_texts, documents, rule_counts

ROW = ["doc_id", *rules.COUNTS]


def test_counts_by_brute_force(spark):
    out = rules.judge(documents(spark))
    assert Counter(map(tuple, out.select(*ROW).collect())) == Counter((k, *rule_counts(t)) for k, t in awkward_texts())
    for r in out.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert rules.judge(documents(spark, [])).collect() == []


def test_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(tuple(out[k][c] for c in rules.COUNTS) == rule_counts(t) for k, t in texts.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[k], r["kept"]) for k, r in out.items() if k in labels and not r["base_failed"]]
    assert sum(kept for y, kept in judged if y) >= 0.98 * sum(y for y, _ in judged)
    assert sum(not kept for y, kept in judged if not y) >= 0.9 * sum(not y for y, _ in judged)


def test_estimation_finds_which_rules_can_be_trusted():
    # Rule 0 and 1 agree; rule 2 votes at random.
    patterns = {(1, 1, 1): 450, (1, 1, -1): 450, (-1, -1, 1): 50, (-1, -1, -1): 50, (0, 0, 1): 10}
    found = rules.estimate(patterns, 3)
    assert found.log_odds((1, 1, -1)) > 0 > found.log_odds((-1, -1, 1))
    assert abs(found.evidence(2, -1)) < abs(found.evidence(0, -1)) / 4
    assert found.evidence(0, 0) == 0.0
    assert found.good == pytest.approx(0.9, abs=0.02)
    assert 0 < rules.estimate({}, 3).good < 1


def test_no_python_on_the_executors(spark):
    plan = rules.judge(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pattern_counts_are_all_the_driver_sees(spark):
    voted = rules.votes(rules.counts(documents(spark)))
    assert voted.groupBy(*[f"vote_{r.name}" for r in rules.RULES]).count().count() <= 3 ** len(rules.RULES)
