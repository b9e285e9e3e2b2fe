import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from convoeval import schemas
from convoeval.operators import backends as B
from convoeval.operators.inference import CallOptions, call_with_retry, infer, infer_to_table, materialise, without_waits
from convoeval.operators.prompts import programs_table
from convoeval.operators.responses import fold_structured_call, fold_text_call
from convoeval.plans.jobs import generate_and_split, judge_structured, judge_with_programs
from convoeval.sources.tables import read_split

FAST = without_waits()


def logged(log, inner=B.rule_reply):
    """``inner``, with one line per client made and per call in a file."""

    def note(text):
        with open(log, "a") as f:
            f.write(text + "\n")

    def factory():
        note("client")
        client = inner()

        def call(request):
            note("call")
            return client(request)

        return call

    return factory


def lines(log, what):
    return open(log).read().split().count(what) if os.path.exists(log) else 0


def table(spark, n=40, partitions=4):
    return spark.range(n).select(
        F.col("id").cast("string").alias("conversation_id"),
        F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
        F.lit("wide").alias("other"),
    ).repartition(partitions)


def ask(df, backend, **options):
    return infer(df, {"m": backend}, "m", "text", options=options.pop("options", FAST), **options)


def test_rows_are_kept_and_columns_follow(spark):
    got = fold_text_call(ask(table(spark), B.rule_reply)).collect()
    assert len(got) == 40
    assert all(r["llm_response"] == "Thank you. We read your 2 words and will help." for r in got)
    assert {(r["other"], r["input_tokens"], r["output_tokens"], r["attempts"]) for r in got} == {("wide", 2, 10, 1)}


def test_one_client_per_task_and_one_call_per_row(spark, tmp_path):
    log = str(tmp_path / "log")
    stored = materialise(ask(table(spark, partitions=3), logged(log)))
    first = lines(log, "call"), lines(log, "client")
    assert first == (40, 3)
    assert stored.count() == 40 and stored.filter("call.error is null").count() == 40
    assert (lines(log, "call"), lines(log, "client")) == first


def test_a_call_is_made_once_however_often_its_fields_are_used(spark, tmp_path):
    log = str(tmp_path / "log")
    folded = fold_structured_call(ask(table(spark), logged(log, B.rule_verdict), system_prompt="at least 1 words"))
    got = folded.filter("input_tokens > 0 and response.satisfied").agg(F.count("*"), F.max("response.explanation")).first()
    assert got[0] == 40 and lines(log, "call") == 40


def test_retries_and_failures():
    request = {"user": "a b", "system": None, "provider": "m"}
    twice = call_with_retry(B.flaky(B.rule_reply, lambda r: 1)(), request, FAST)
    assert (twice["attempts"], twice["error"]) == (2, None) and twice["response_text"]
    never = call_with_retry(B.failing(B.rule_reply, lambda r: True)(), request, FAST)
    assert (never["attempts"], never["response_text"]) == (3, None) and "busy" in never["error"]


def test_waits_grow_and_are_capped(monkeypatch):
    waits = []
    monkeypatch.setattr(time, "sleep", waits.append)
    options = CallOptions(tries=5, backoff_base=2.0, backoff_cap=3.0)
    call_with_retry(B.failing(B.rule_reply, lambda r: True)(), {"user": "a"}, options)
    assert len(waits) == 4 and all(0 <= w <= min(3.0, 2.0**i) for i, w in enumerate(waits))


def test_failed_rows_have_no_response_and_no_tokens(spark):
    backend = B.failing(B.rule_reply, lambda r: r["user"].endswith("7"))
    got = fold_text_call(ask(table(spark), backend)).collect()
    failed = [r for r in got if r["error"]]
    assert len(got) == 40 and len(failed) == 4
    assert all((r["llm_response"], r["llm_metadata"], r["input_tokens"], r["output_tokens"]) == (None, None, 0, 0) for r in failed)


def test_missing_input_is_not_sent(spark, tmp_path):
    log = str(tmp_path / "log")
    df = table(spark).withColumn("text", F.when(F.col("conversation_id") != "3", F.col("text")))
    got = [r for r in ask(df, logged(log)).collect() if r["text"] is None]
    assert len(got) == 1 and got[0]["call"]["error"] == "no input" and got[0]["call"]["attempts"] == 0
    assert lines(log, "call") == 39


def test_unknown_provider(spark):
    with pytest.raises(ValueError, match="unknown provider"):
        infer(table(spark), {"m": B.rule_reply}, "other", "text")
    by_row = infer(table(spark), {"m": B.rule_reply}, F.lit("other"), "text", options=FAST)
    assert {r["call"]["error"] for r in by_row.collect()} == {"unknown provider: other"}


def test_client_that_cannot_be_made_gives_error_rows(spark):
    def no_key():
        raise KeyError("API key")

    got = ask(table(spark), no_key).collect()
    assert len(got) == 40 and all("client setup failed" in r["call"]["error"] for r in got)


def test_concurrency_cap(spark, tmp_path):
    options = CallOptions(partitions=2, threads=3, backoff_base=0.0)
    df = ask(table(spark, partitions=9), B.rule_reply, options=options)
    assert df.rdd.getNumPartitions() == 2

    def slow():
        return lambda request: time.sleep(0.05) or {"text": "x", "metadata": None}

    one = table(spark, 24, 1)
    started = time.time()
    ask(one, slow, options=CallOptions(threads=12)).write.format("noop").mode("overwrite").save()
    assert time.time() - started < 24 * 0.05


def test_answers_are_stored_and_resumed(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    fails = B.failing(B.rule_reply, lambda r: r["user"].endswith("5"))
    options = {"provider": "m", "input_field": "text", "keys": ["conversation_id"], "options": CallOptions(tries=1)}
    first = infer_to_table(table(spark), path, {"m": logged(log, fails)}, **options)
    assert first.count() == 40 and first.filter("call.error is not null").count() == 4
    assert lines(log, "call") == 40
    # Again with ten new rows: only the failed and the new ones are asked.
    second = infer_to_table(table(spark, 50), path, {"m": logged(log, fails)}, **options)
    assert lines(log, "call") == 40 + 4 + 10
    assert second.count() == 50 and second.filter("call.error is not null").count() == 5
    third = infer_to_table(table(spark, 50), path, {"m": logged(log)}, **options)
    assert lines(log, "call") == 54 + 5
    assert third.count() == 50 and third.filter("call.error is not null").count() == 0
    assert third.select("conversation_id").distinct().count() == 50


def test_structured_answers_that_do_not_fit_are_failures(spark):
    def wrong():
        return lambda request: {"text": '{"satisfied": "maybe"}', "metadata": {"usage": {"prompt_tokens": 5}}}

    row = judge_structured(table(spark, 1), wrong, "text", options=FAST).first()
    assert row["satisfied"] is None and row["input_tokens"] == 0 and row["llm_metadata"] is None
    assert row["error"] == "response does not fit the schema"


def test_metadata_of_any_object_is_written():
    class Dumps:
        def model_dump(self):
            return {"id": "x", "when": object}

    class Broken:
        def model_dump(self):
            raise RuntimeError("no")

    usage = SimpleNamespace(prompt_tokens=1, completion_tokens=2, total_tokens=3)
    completion = SimpleNamespace(id="c", model="m", usage=usage, choices=[SimpleNamespace(finish_reason="stop")])
    assert B.metadata_to_json(None) is None
    assert '"id": "x"' in B.metadata_to_json(Dumps())
    assert "cannot be written" in B.metadata_to_json(Broken())
    assert '"total_tokens": 3' in B.metadata_to_json(completion) and '"finish_reason": "stop"' in B.metadata_to_json(completion)
    assert '"prompt_tokens": 0' in B.metadata_to_json(SimpleNamespace(id="c", usage=None, choices=[]))
    assert B.metadata_to_json(SimpleNamespace(a=1, b=object())).startswith('{"a": 1, "b": "<object')
    assert B.metadata_to_json("text") == '{"raw": "text"}' and B.metadata_to_json(5) == '{"raw": "5"}'


def _programs(spark, numbers, padding=""):
    return programs_table(
        spark,
        [
            {"program_id": f"p{n}", "task": "judge", "instruction": f"at least {n} words{padding}", "output_field": "satisfied"}
            for n in numbers
        ]
        + [{"program_id": "other", "task": "reply", "instruction": "x", "output_field": "y"}],
    )


def test_programs_travel_as_numbers_and_every_reply_is_asked_once(spark, tmp_path):
    from convoeval.plans.jobs import score_generators

    rows = table(spark, 10).withColumn("a_map", F.create_map(F.lit("k"), "conversation_id"))
    judged = judge_with_programs(rows, _programs(spark, (1, 2, 3)), B.rule_program_verdict, "text", FAST)
    assert judged.count() == 30
    from convoeval.operators.prompts import with_program_prompts

    texts = with_program_prompts(rows, _programs(spark, (1, 2, 3)), "judge", "text")
    plain = fold_structured_call(
        infer(texts, {"m": B.rule_program_verdict}, "m", "user_prompt", F.col("system_prompt"), options=FAST, schema=schemas.PROGRAM_VERDICT),
        schemas.PROGRAM_VERDICT,
    )
    want = sorted((r["conversation_id"], r["program_id"], str(r["response"]["satisfied"]).lower()) for r in plain.collect())
    assert sorted((r["conversation_id"], r["program_id"], str(r["satisfied"]).lower()) for r in judged.collect()) == want
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "at least 1 words" not in plan  # prompt texts are not in the plan, only their numbers
    replies, log = str(tmp_path / "replies"), str(tmp_path / "log")
    generator = programs_table(spark, [{"program_id": "g", "task": "reply", "instruction": "reply", "output_field": "llm_response"}])
    scored = score_generators(
        rows.withColumnRenamed("text", "transcript"), generator, logged(replies, B.rule_program_reply),
        _programs(spark, (1, 2), " padding" * 320_000), logged(log, B.rule_program_verdict), options=FAST,
    )
    assert scored.count() == 20
    assert lines(replies, "call") == 10 and lines(log, "call") == 20  # two 2.5 MB judges: 10 replies


def test_five_megabytes_of_prompts(spark):
    judged = judge_with_programs(
        table(spark, 3), _programs(spark, (1, 2), " padding" * 320_000), B.rule_program_verdict, "text", FAST
    )
    assert judged.count() == 6


def test_registry_keeps_versions(spark, tmp_path):
    from convoeval.operators.prompts import latest_programs, load_programs, save_programs

    path = str(tmp_path / "programs")
    first = {"program_id": "p", "task": "judge", "instruction": "old", "output_field": "satisfied"}
    save_programs(programs_table(spark, [first]), path)
    save_programs(programs_table(spark, [{**first, "version": 2, "instruction": "new"}]), path)
    assert load_programs(spark, path).count() == 2
    assert [(r["version"], r["instruction"]) for r in latest_programs(load_programs(spark, path)).collect()] == [(2, "new")]


def test_jobs_with_a_path_call_once(spark, tmp_path):
    log = str(tmp_path / "log")
    judged = judge_structured(table(spark, 12), logged(log), "text", options=FAST, path=str(tmp_path / "judged"))
    assert judged.count() == 12 and len(judged.collect()) == 12
    # The logging backend answers plain text, which is no verdict: each call is tried three times.
    assert lines(log, "call") == 36


def test_the_rate_is_that_of_all_tasks_and_attempts(spark, tmp_path):


    def always_failing():
        def call(request):
            raise ConnectionError("no")

        return call

    options = CallOptions(partitions=4, threads=3, calls_per_second=20.0, tries=2, backoff_base=0.0)
    started = time.time()
    infer(table(spark, 40), {"m": always_failing}, "m", "text", options=options).collect()
    assert 80 / (time.time() - started) <= 20.0 * 1.1
    with pytest.raises(ValueError, match="needs partitions"):
        CallOptions(calls_per_second=2.0)


def test_null_and_repeated_keys_are_asked_once_over_two_runs(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")
    rows = [(None, "a"), ("x", "b"), ("x", "b"), ("y", "c")]
    df = spark.createDataFrame(rows, "conversation_id string, text string")
    ask = {"provider": "m", "input_field": "text", "keys": ["conversation_id"], "options": FAST}
    assert infer_to_table(df, path, {"m": logged(log)}, **ask).count() == 3
    assert infer_to_table(df, path, {"m": logged(log)}, **ask).count() == 3
    assert lines(log, "call") == 3


def test_generate_and_split_asks_once_per_sampled_row(spark, tmp_path):
    path, log = str(tmp_path / "splits"), str(tmp_path / "log")
    rows = [(str(i), "A", f"Customer: q{i}\nAgent: a\nCustomer: r") for i in range(90)]
    generate_and_split(spark.createDataFrame(rows, schemas.CONVERSATION), logged(log), path, 50, options=FAST)
    assert lines(log, "call") == 50
    assert read_split(spark, path, "test").count() == 20 and read_split(spark, path, "train").count() == 30
    assert read_split(spark, path, "test").filter("output_transcript is null").count() == 0


def test_a_version_is_saved_once_even_by_two_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from convoeval.operators.prompts import VersionTaken, load_programs, save_programs

    path = str(tmp_path / "programs")
    one = {"program_id": "p", "task": "judge", "instruction": "old", "output_field": "satisfied"}
    save_programs(programs_table(spark, [one]), path)
    with pytest.raises(VersionTaken):
        save_programs(programs_table(spark, [{**one, "instruction": "other"}]), path)
    with pytest.raises(VersionTaken):
        save_programs(programs_table(spark, [{**one, "version": 3}, {**one, "version": 3}]), path)

    def save(text):
        try:
            save_programs(programs_table(spark, [{**one, "version": 2, "instruction": text}]), path)
            return True
        except VersionTaken:
            return False

    with ThreadPoolExecutor(2) as pool:
        won = list(pool.map(save, ["a", "b"]))
    assert sorted(won) == [False, True]
    assert sorted(r["version"] for r in load_programs(spark, path).collect()) == [1, 2]
