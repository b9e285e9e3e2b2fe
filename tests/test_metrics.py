import pytest
from pyspark.sql import functions as F

from convoeval.operators import candidates, comparison, metrics
from convoeval.operators.prompts import programs_table


def pairs(spark, rows):
    return spark.createDataFrame(rows, "prediction string, gold_standard string")


def test_token_statistics(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (10, 4)], "input_tokens long, output_tokens long")
    assert metrics.token_statistics(df).first().asDict() == {
        "total_examples": 3, "successful_calls": 2, "failed_calls": 1, "total_input_tokens": 15,
        "total_output_tokens": 4, "avg_input_tokens": 7.5, "avg_output_tokens": 4.0,
    }
    failed = metrics.token_statistics(df.filter("input_tokens = 0")).first()
    assert (failed["avg_input_tokens"], failed["avg_output_tokens"], failed["total_input_tokens"]) == (0.0, 0.0, 0)
    assert metrics.token_statistics(df.filter("false")).first()["total_examples"] == 0


def test_distribution(spark):
    df = spark.createDataFrame([("true",), ("true",), ("false",), (None,)], "satisfied string")
    assert [tuple(r) for r in metrics.verdict_distribution(df).orderBy("position").collect()] == [
        (0, "true", 2, 50.0), (1, "false", 1, 25.0)
    ]
    none = metrics.verdict_distribution(df.filter("satisfied = 'true'")).orderBy("position").collect()
    assert (none[1]["n"], none[1]["percent"]) == (0, None)


def test_agreement_and_matches(spark):
    df = pairs(spark, [("true", "true"), ("true", "false"), (None, None), (None, "true")])
    assert metrics.agreement_rate(df).first()["agreement"] == 0.25
    rows = spark.createDataFrame(
        [(0, "True", " true "), (1, "True", "False"), (2, None, None), (3, None, "none")], "k int, a string, b string"
    )
    matched = rows.withColumn("m", metrics.exact_match(F.col("a"), F.col("b"))).orderBy("k").collect()
    assert [r["m"] for r in matched] == [1, 0, 1, 1]
    said = spark.createDataFrame([(0, "True"), (1, "False"), (2, " true"), (3, None)], "k int, v string")
    assert [r["j"] for r in said.withColumn("j", metrics.judged_true(F.col("v"))).orderBy("k").collect()] == [1, 0, 0, 0]


def test_kappa(spark):
    perfect = pairs(spark, [("true", "true"), ("false", "false")] * 3)
    assert metrics.cohen_kappa(perfect).first()["kappa"] == 1.0
    one_label = metrics.cohen_kappa(pairs(spark, [("true", "true")] * 4)).first()
    assert (one_label["kappa"], one_label["observed"]) == (None, 1.0)
    # 20 + 15 agreements of 50: po = 0.7, pe = 0.5
    known = [("yes", "yes")] * 20 + [("yes", "no")] * 5 + [("no", "yes")] * 10 + [("no", "no")] * 15
    row = metrics.cohen_kappa(pairs(spark, known + [(None, "yes"), ("no", None)])).first()
    assert (row["total"], row["observed"], row["expected"], row["kappa"]) == (50, 0.7, 0.5, 0.4)
    assert metrics.cohen_kappa(perfect.filter("false")).first()["total"] == 0


def test_join_drops_missing_keys(spark):
    p = spark.createDataFrame([("1", "true"), (None, "true")], "conversation_id string, satisfied string")
    assert metrics.prediction_with_gold(p, p, check_keys=True).count() == 1
    with pytest.raises(ValueError):
        metrics.prediction_with_gold(p, p.union(p.filter("conversation_id = '1'")), check_keys=True)


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (-0.5,), (None,)], "v double")
    got = {(r["bin"], r["n"], r["bin_start"]) for r in metrics.histogram(df, "v", 0, 10).collect()}
    assert got == {(0, 2, 0.0), (1, 1, 10.0), (-1, 1, -10.0)}


def test_switched(spark):
    verdicts = [("true", "false"), ("true", "true"), (None, None), (None, "true")]
    def run(i):
        return spark.createDataFrame([(k, "t", "e", v[i]) for k, v in enumerate(verdicts)], "conversation_id long, output_transcript string, explanation string, satisfied string")
    compared = comparison.compare_runs(run(0), run(1))
    assert compared.count() == 4 and dict(compared.dtypes)["conversation_id"] == "string"
    assert sorted(r["conversation_id"] for r in comparison.switched_verdicts(compared).collect()) == ["0", "3"]
    assert [r["optimized_satisfied"] for r in comparison.switched_report(compared).collect()] == ["false", "true"]


def judged(spark):
    rows = [(f"p{p}", str(k), "True" if k % 2 else "False", "true" if k % (p + 1) else "false") for p in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "program_id string, conversation_id string, gold_standard string, satisfied string")
    return candidates.add_match(df.withColumn("version", F.lit(1)))


def test_candidates(spark):
    scores = {r["program_id"]: r["score"] for r in candidates.candidate_scores(judged(spark)).collect()}
    assert scores["p1"] == 100.0 and scores["p2"] == 50.0
    assert candidates.best_candidate(judged(spark)).first()["program_id"] == "p1"
    tie = judged(spark).withColumn("metric", F.lit(1))
    assert candidates.best_candidate(tie).first()["program_id"] == "p1"
    assert candidates.best_candidate(tie.filter("false")).count() == 0


def test_versions_are_scored_apart(spark):
    both = judged(spark).filter("program_id = 'p1'")
    both = both.unionByName(both.withColumns({"version": F.lit(2), "metric": F.lit(0)}))
    scores = {(r["program_id"], r["version"]): (r["examples"], r["score"]) for r in candidates.candidate_scores(both).collect()}
    assert scores == {("p1", 1): (60, 100.0), ("p1", 2): (60, 0.0)}
    best = candidates.best_candidate(both).first()
    assert (best["program_id"], best["version"]) == ("p1", 1)


def test_demos_do_not_depend_on_partitions(spark):
    demos = candidates.select_demos(judged(spark), k=2)
    same = candidates.select_demos(judged(spark).repartition(13), k=2)
    assert sorted(map(tuple, demos.collect())) == sorted(map(tuple, same.collect()))
    assert demos.groupBy("program_id", "gold_standard").count().filter("count > 2").count() == 0
    plan = demos._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 2, Partial" in plan

    programs = programs_table(spark, [{"program_id": p, "task": "judge", "instruction": "i", "output_field": "satisfied"} for p in ("p1", "p3")])
    named = demos.withColumn("transcript", F.col("conversation_id"))
    out = {r["program_id"]: r["demos"] for r in candidates.attach_demos(programs, named).collect()}
    assert [d["output"] for d in out["p1"]] == ["False", "False", "True", "True"] and out["p3"] == []


@pytest.mark.parametrize("partitions", [1, 9])
def test_metrics_do_not_depend_on_partitions(spark, partitions):
    df = pairs(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")] * 25).repartition(partitions)
    assert metrics.cohen_kappa(df).first()["kappa"] == 0.2
