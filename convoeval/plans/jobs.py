"""The jobs of the workflow, composed from the operators.

A job with a ``path`` keeps its model calls in an answer log there (``operators.answer_log``):
it asks only the requests that no committed wave answered, in ``waves`` slices that each commit
on their own, so a job killed at 99 % asks the last 1 % when it is run again. What it returns is
read from the log: each input row with the answer of its current request, whatever older prompts
left there. Answers are told by ``keys`` and the request; by default the keys are those of
``conversation_id``, ``doc_id``, ``program_id`` and ``version`` that the rows have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval import schemas
from convoeval.operators.backends import Backend
from convoeval.operators.candidates import add_match
from convoeval.operators import answer_log
from convoeval.operators.inference import REQUEST, CallOptions, infer
from convoeval.operators.metrics import judged_true
from convoeval.operators.prompts import (
    JUDGE_INSTRUCTION,
    REPLY_INSTRUCTION,
    SYNTHESIS_INSTRUCTION,
    judge_context,
    output_transcript,
    with_program_numbers,
)
from convoeval.operators.responses import (
    extract_program_verdict,
    extract_structured_verdict,
    fold_structured_call,
    fold_text_call,
    split_company_and_conversation,
)
from convoeval.operators.sampling import seeded_sample, train_test_split
from convoeval.operators.turns import truncate_table
from convoeval.sources.tables import save_splits


KEY_NAMES = ("conversation_id", "doc_id", "program_id", "version")


def _ask(
    df: DataFrame,
    backend: Backend,
    input_field: str,
    system_prompt,
    options: CallOptions,
    path: str | None,
    keys: Sequence[str] | None = None,
    schema=None,
    model_name=None,
    temperature=None,
    waves: int = 1,
    system_prompts=None,
    request_system=None,
) -> DataFrame:
    """``df`` with ``call``: asked now, or with a path through the answer log there."""
    if path is None:
        return infer(
            df, {"model": backend}, "model", input_field, system_prompt, model_name, temperature, options, schema,
            system_prompts,
        )
    keys = [k for k in KEY_NAMES if k in df.columns] if keys is None else list(keys)
    asked = answer_log.ask(
        df, path, {"model": backend}, "model", input_field, keys, system_prompt, model_name, temperature,
        options, schema, answer_log.LogOptions(waves=waves), system_prompts, request_system,
    )
    return asked.drop(REQUEST)


def add_judge_context(df: DataFrame) -> DataFrame:
    """Add ``company_and_transcript`` from ``company`` and ``truncated_conversation``."""
    return df.withColumn(
        "company_and_transcript", judge_context(F.col("company"), F.col("truncated_conversation"))
    )


def augmented_contexts(conversations: DataFrame, seed: int = 101, min_turns: int = 1) -> DataFrame:
    """Truncate and build the judge context."""
    return add_judge_context(truncate_table(conversations, seed, min_turns=min_turns))


def synthesise_conversations(
    seeds: DataFrame,
    backend: Backend,
    options: CallOptions = CallOptions(temperature=1.0),
    path: str | None = None,
    keys: Sequence[str] | None = None,
    waves: int = 1,
) -> DataFrame:
    """Seed messages to synthetic conversations with company and text.

    This and the other jobs call the model whenever their rows are read. With ``path`` they
    keep the answers there and ask only what is missing (see the module).
    """
    asked = _ask(seeds, backend, "Text", SYNTHESIS_INSTRUCTION, options, path, keys, waves=waves)
    return split_company_and_conversation(fold_text_call(asked))


def generate_replies(
    contexts: DataFrame,
    backend: Backend,
    options: CallOptions = CallOptions(temperature=1.0),
    path: str | None = None,
    keys: Sequence[str] | None = None,
    waves: int = 1,
) -> DataFrame:
    """Contexts to replies and output transcripts, with a plain text model."""
    asked = _ask(contexts, backend, "company_and_transcript", REPLY_INSTRUCTION, options, path, keys, waves=waves)
    full = output_transcript(F.col("company_and_transcript"), F.col("llm_response"))
    return fold_text_call(asked).withColumn("output_transcript", full)


def generate_and_split(
    conversations: DataFrame,
    backend: Backend,
    path: str,
    n_samples: int = 400,
    test_size: float = 0.4,
    seed: int = 10,
    truncate_seed: int = 101,
    options: CallOptions = CallOptions(temperature=1.0),
    answers: str | None = None,
) -> None:
    """Truncate, sample, reply and store as the splits ``train`` and ``test``.

    Sample and split depend on the keys alone and are decided before the calls, so nothing is
    asked twice. The replies are kept in an answer log at ``answers`` (by default beside
    ``path``, as ``path.answers``), so that a failed write asks nothing again.
    """
    contexts = augmented_contexts(conversations, truncate_seed)
    chosen = train_test_split(seeded_sample(contexts, n_samples, seed), test_size, seed)
    log = answers or f"{path.rstrip('/')}.answers"
    save_splits(generate_replies(chosen, backend, options, path=log), path)


def judge_structured(
    transcripts: DataFrame,
    backend: Backend,
    input_field: str = "output_transcript",
    key: str = "conversation_id",
    instruction: str = JUDGE_INSTRUCTION,
    options: CallOptions = CallOptions(),
    path: str | None = None,
    waves: int = 1,
) -> DataFrame:
    """Transcripts to ``satisfied BOOLEAN`` and ``explanation``."""
    rows = transcripts.select(key, input_field)
    asked = _ask(rows, backend, input_field, instruction, options, path, [key], schemas.STRUCTURED_VERDICT, waves=waves)
    return extract_structured_verdict(fold_structured_call(asked))


def run_programs(
    df: DataFrame,
    programs: DataFrame,
    task: str,
    backend: Backend,
    schema=schemas.PROGRAM_VERDICT,
    input_field: str = "transcript",
    options: CallOptions = CallOptions(),
    path: str | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Every program of a task on every row: ``program_id``, ``version`` and a typed ``response``.

    A failed call gives a null response with its error, so no row is lost.
    """
    prompts, numbers = with_program_numbers(df, programs, task, input_field)
    asked = _ask(
        prompts, backend, "user_prompt", F.col("program_no"), options, path, keys, schema,
        F.col("model_name"), F.col("temperature"), system_prompts=numbers, request_system=F.col("system_hash"),
    )
    dropped = ("program_no", "system_hash", "user_prompt", "model_name", "temperature", "output_field")
    return fold_structured_call(asked, schema).drop(*dropped)


def judge_with_programs(
    transcripts: DataFrame,
    programs: DataFrame,
    backend: Backend,
    input_field: str = "output_transcript",
    options: CallOptions = CallOptions(),
    path: str | None = None,
) -> DataFrame:
    """Transcripts to text verdicts per judge program."""
    return extract_program_verdict(
        run_programs(transcripts, programs, "judge", backend, input_field=input_field, options=options, path=path)
    )


def score_judges(
    examples: DataFrame,
    programs: DataFrame,
    backend: Backend,
    input_field: str = "transcript",
    options: CallOptions = CallOptions(),
    path: str | None = None,
) -> DataFrame:
    """Examples with ``gold_standard`` to one ``metric`` row per (program, version, example)."""
    return add_match(judge_with_programs(examples, programs, backend, input_field, options, path))


def score_generators(
    examples: DataFrame,
    generators: DataFrame,
    reply_backend: Backend,
    judges: DataFrame,
    judge_backend: Backend,
    input_field: str = "transcript",
    options: CallOptions = CallOptions(),
    path: str | None = None,
) -> DataFrame:
    """Replies of every generator program judged by a judge program: metric 1 if satisfied.

    The two model calls are two Arrow stages of the same task; nothing is shuffled between.
    """
    replies = run_programs(
        examples, generators, "reply", reply_backend, schemas.PROGRAM_REPLY, input_field, options,
        path and f"{path}/reply",
    )
    full = replies.withColumn(
        "output_transcript", output_transcript(F.col(input_field), F.col("response.llm_response"))
    ).withColumnsRenamed({"program_id": "generator_id", "version": "generator_version"})
    judged = judge_with_programs(
        full.drop("response", "error"), judges, judge_backend, options=options, path=path and f"{path}/judge"
    )
    names = {"program_id": "judge_id", "version": "judge_version"}
    scored = judged.withColumn("metric", judged_true(F.col("satisfied"))).withColumnsRenamed(names)
    return scored.withColumnsRenamed({"generator_id": "program_id", "generator_version": "version"})
