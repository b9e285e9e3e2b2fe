"""The answer log: kills, resumes, changed prompts, compaction, vacuum and claims."""

import pytest
from pyspark.sql import functions as F

from convoeval import schemas
from convoeval.operators import answer_log
from convoeval.operators import backends as B
from convoeval.operators.prompts import programs_table
from convoeval.plans.jobs import judge_structured, score_generators
from test_inference import FAST, lines, logged, table


def killing(inner, dies):
    class Killed(BaseException):
        """Not an Exception: retries do not catch it, so the task and the job fail."""

    def factory():
        client = inner()

        def call(request):
            if dies(request):
                raise Killed("executor lost")
            return client(request)

        return call

    return factory


ASK = {"provider": "m", "input_field": "text", "keys": ["conversation_id"], "options": FAST}


def test_a_killed_job_asks_only_the_rest_when_run_again(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    df = table(spark, 60)
    waves = answer_log.LogOptions(waves=4)
    dies = lambda r: r["user"].endswith(" 59")
    with pytest.raises(Exception):
        answer_log.ask(df, path, {"m": killing(logged(log), dies)}, log_options=waves, **ASK).collect()
    done_before = answer_log.read_log(spark, path)
    stored = 0 if done_before is None else done_before.count()
    assert 0 < stored < 60  # some waves committed before the one that died
    calls = lines(log, "call")
    got = answer_log.ask(df, path, {"m": logged(log)}, log_options=waves, **ASK)
    assert got.count() == 60 and got.filter("call.error is null").count() == 60
    # The second run asked exactly what had no committed answer.
    assert lines(log, "call") - calls == 60 - stored
    assert answer_log.ask(df, path, {"m": logged(log)}, **ASK).count() == 60
    assert lines(log, "call") - calls == 60 - stored


def test_a_changed_prompt_returns_only_current_answers(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    df = table(spark, 10)
    first = answer_log.ask(df, path, {"m": logged(log)}, system_prompt="old", **ASK)
    assert first.count() == 10
    second = answer_log.ask(df, path, {"m": logged(log)}, system_prompt="new", **ASK)
    assert second.count() == 10 and lines(log, "call") == 20
    assert answer_log.read_log(spark, path).count() == 20  # both stay in the log
    back = answer_log.ask(df, path, {"m": logged(log)}, system_prompt="old", **ASK)
    assert back.count() == 10 and lines(log, "call") == 20


def test_schema_is_part_of_the_request(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    df = table(spark, 5)
    answer_log.ask(df, path, {"m": logged(log)}, **ASK).collect()
    structured = answer_log.ask(df, path, {"m": logged(log, B.rule_verdict)}, schema=schemas.STRUCTURED_VERDICT, **ASK)
    assert structured.filter("call.error is null").count() == 5
    assert lines(log, "call") == 10


def test_null_and_repeated_keys_and_empty_frames(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    rows = [(None, "a"), ("x", "b"), ("x", "b"), ("y", "c")]
    df = spark.createDataFrame(rows, "conversation_id string, text string")
    assert answer_log.ask(df.filter(F.lit(False)), path, {"m": logged(log)}, **ASK).count() == 0
    assert answer_log.ask(df, path, {"m": logged(log)}, **ASK).count() == 4
    assert answer_log.ask(df, path, {"m": logged(log)}, **ASK).count() == 4
    assert lines(log, "call") == 3


def test_compaction_keeps_one_scan_and_vacuum_removes_replaced_waves(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    few = answer_log.LogOptions(waves=1, compact_after=3)
    for n in range(1, 8):
        answer_log.ask(table(spark, 4 * n), path, {"m": logged(log)}, log_options=few, **ASK).collect()
    assert lines(log, "call") == 28
    kinds = [k for _, k in answer_log.entries(spark, path)]
    assert "base" in kinds
    plan = answer_log.read_log(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert answer_log.vacuum(spark, path) > 0
    got = answer_log.ask(table(spark, 28), path, {"m": logged(log)}, log_options=few, **ASK)
    assert got.count() == 28 and lines(log, "call") == 28


def test_a_number_is_claimed_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    answer_log._claim(spark, path, 5, "wave")
    with pytest.raises(Exception):
        answer_log._claim(spark, path, 5, "wave")


def test_jobs_resume_through_the_log(spark, tmp_path):
    path, log = str(tmp_path / "judged"), str(tmp_path / "log")
    df = table(spark, 30)
    dies = lambda r: r["user"].endswith(" 29")
    with pytest.raises(Exception):
        judge_structured(df, killing(logged(log, B.rule_verdict), dies), "text", options=FAST, path=path, waves=3).collect()
    before = lines(log, "call")
    judged = judge_structured(df, logged(log, B.rule_verdict), "text", options=FAST, path=path, waves=3)
    assert judged.count() == 30 and judged.filter("error is null").count() == 30
    assert lines(log, "call") - before < 30


def test_score_generators_with_a_path_asks_once(spark, tmp_path):
    path, replies, verdicts = str(tmp_path / "scores"), str(tmp_path / "replies"), str(tmp_path / "verdicts")
    examples = table(spark, 6).withColumnRenamed("text", "transcript")
    generators = programs_table(spark, [{"program_id": "g", "task": "reply", "instruction": "reply", "output_field": "llm_response"}])
    judges = programs_table(
        spark, [{"program_id": "j", "task": "judge", "instruction": "Answer True if the last line has at least 3 words.", "output_field": "satisfied"}]
    )
    args = (examples, generators, logged(replies, B.rule_program_reply), judges, logged(verdicts, B.rule_program_verdict))
    first = score_generators(*args, options=FAST, path=path).collect()
    again = score_generators(*args, options=FAST, path=path).collect()
    assert len(first) == len(again) == 6
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert lines(replies, "call") == 6 and lines(verdicts, "call") == 6


def test_wave_figures_come_from_the_writes(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    df = table(spark, 20)
    fails = lambda r: r["user"].endswith("7")
    answer_log.ask(df, path, {"m": B.failing(logged(log), fails)}, log_options=answer_log.LogOptions(waves=2), **ASK)
    figures = answer_log.wave_figures(spark, path)
    assert len(figures) == 2 and sum(f["calls"] for f in figures) == 20
    stored = answer_log.read_log(spark, path)
    assert sum(f["failed"] for f in figures) == stored.filter("call.error is not null").count() == 2
    assert sum(f["attempts"] for f in figures) == stored.agg(F.sum("call.attempts")).first()[0]
    assert all(f["seconds"] >= 0 for f in figures)
