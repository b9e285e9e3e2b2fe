"""Building what is sent to a model: contexts, chat messages and program prompts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from convoeval import schemas

# Instructions used when the caller gives none.
JUDGE_INSTRUCTION = (
    "You review customer support. Read the transcript and decide whether the last support "
    "message helps the customer. Answer True or False and give a short reason."
)
REPLY_INSTRUCTION = (
    "You answer for a support team. Read the transcript and write the next support message "
    "in a few friendly and accurate sentences."
)
SYNTHESIS_INSTRUCTION = (
    "Write a short chat between a customer and a support agent that starts with the given "
    "message. First name the company, then list the turns one per line."
)

def judge_context(company: Column, transcript: Column) -> Column:
    """Company and transcript as one text. A missing company is printed as ``None``."""
    return F.concat(
        F.lit("Company: "),
        F.coalesce(company, F.lit("None")),
        F.lit("\nTranscript so far: "),
        transcript,
    )


def output_transcript(context: Column, reply: Column) -> Column:
    """The context with the reply appended. No reply gives null, which is not judged."""
    return F.concat(context, F.lit("\nSupport: "), reply)


def chat_messages(system: Column, user: Column) -> Column:
    """ARRAY<STRUCT<role, content>> with the system message first."""
    return F.array(_message("system", system), _message("user", user))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def flat_prompt(system: Column, user: Column) -> Column:
    """System and user text as one prompt."""
    return F.concat(F.lit("System: "), system, F.lit("\n\nUser: "), user)


def provider_request(provider: Column, system: Column, user: Column) -> Column:
    """STRUCT<system, messages, prompt> in the form the row's provider takes.

    ``openai`` takes both messages, ``anthropic`` the system text apart from the user
    message, ``gemini`` one flat prompt. Fields that a provider does not use are null.
    """
    return F.struct(
        F.when(provider == "anthropic", system).alias("system"),
        F.when(provider == "openai", chat_messages(system, user))
        .when(provider == "anthropic", F.array(_message("user", user)))
        .alias("messages"),
        F.when(provider == "gemini", flat_prompt(system, user)).alias("prompt"),
    )


def programs_table(spark: SparkSession, programs: Iterable[Mapping]) -> DataFrame:
    """Prompt programs as a table. It holds prompts and parameters, never credentials."""
    defaults = {
        "version": 1,
        "input_desc": "transcript to read",
        "output_desc": "",
        "demos": [],
        "model_name": None,
        "temperature": 0.0,
    }
    rows = [{**defaults, **program} for program in programs]
    for row in rows:
        row["demos"] = [{"input": given, "output": wanted} for given, wanted in row["demos"]]
    # An Arrow table becomes a local relation, whose size the optimizer knows.
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schemas.PROGRAM))
    return spark.createDataFrame(table, schemas.PROGRAM)


def latest_programs(programs: DataFrame) -> DataFrame:
    """The row with the highest version of every program; of equal versions the last instruction."""
    best = F.max_by(F.struct(*programs.columns), F.struct("version", "instruction", "model_name")).alias("p")
    return programs.groupBy("program_id").agg(best).select("p.*")


def program_system_prompt() -> Column:
    """System text of a program row: instruction, fields, then the demos in order."""
    demos = F.transform(
        "demos",
        lambda d: F.concat(
            F.lit("Example\ntranscript: "), d["input"], F.lit("\n"), F.col("output_field"), F.lit(": "), d["output"]
        ),
    )
    fields = F.concat(
        F.lit("Input: transcript - "),
        F.col("input_desc"),
        F.lit("\nOutput: reasoning, "),
        F.col("output_field"),
        F.lit(" - "),
        F.col("output_desc"),
    )
    return F.array_join(F.concat(F.array(F.col("instruction"), fields), demos), "\n\n")


def program_user_prompt(transcript: Column) -> Column:
    return F.concat(F.lit("transcript: "), transcript)


def _program_rows(programs: DataFrame, task: str) -> list:
    """The programs of ``task`` with their system prompts, in order of id and version.

    A registry of programs is collected: its size is that of the prompts, not of the rows.
    """
    return (
        programs.filter(F.col("task") == task)
        .select("program_id", "version", "output_field", "model_name", "temperature", program_system_prompt().alias("system_prompt"))
        .orderBy("program_id", "version")
        .collect()
    )


def with_program_numbers(
    df: DataFrame, programs: DataFrame, task: str, input_field: str = "transcript"
) -> tuple[DataFrame, dict[int, str]]:
    """Every row once per program of ``task``, and the system prompts by program number.

    The rows get ``program_no``, ``program_id``, ``version``, ``output_field``, ``model_name``,
    ``temperature``, ``system_hash`` (SHA-256 of the system prompt) and ``user_prompt``, but not
    the system prompt itself: that goes to the tasks once, as the dictionary, and is looked up
    where the model is called. Rows are repeated where they are read; nothing is shuffled, and
    rows may have columns of any type. No program gives no rows.
    """
    listed = _program_rows(programs, task)
    meta = [
        F.struct(
            F.lit(i).alias("program_no"),
            F.lit(r["program_id"]).cast("string").alias("program_id"),
            F.lit(r["version"]).cast("int").alias("version"),
            F.lit(r["output_field"]).cast("string").alias("output_field"),
            F.lit(r["model_name"]).cast("string").alias("model_name"),
            F.lit(r["temperature"]).cast("double").alias("temperature"),
            F.lit(hashlib.sha256((r["system_prompt"] or "").encode()).hexdigest()).alias("system_hash"),
        )
        for i, r in enumerate(listed)
    ]
    if meta:
        repeated = df.select("*", F.inline(F.array(*meta)))
    else:
        fields = (("program_no", "int"), ("program_id", "string"), ("version", "int"), ("output_field", "string"),
                  ("model_name", "string"), ("temperature", "double"), ("system_hash", "string"))
        repeated = df.filter(F.lit(False)).select("*", *[F.lit(None).cast(t).alias(n) for n, t in fields])
    numbers = {i: r["system_prompt"] for i, r in enumerate(listed)}
    return repeated.withColumn("user_prompt", program_user_prompt(F.col(input_field))), numbers


def with_program_prompts(
    df: DataFrame, programs: DataFrame, task: str, input_field: str = "transcript"
) -> DataFrame:
    """Every row with the prompts of every program of ``task``, the system prompt as text.

    The texts are joined by program number from a table of the programs, so that no plan
    carries them as literals; calls should use ``with_program_numbers``.
    """
    repeated, numbers = with_program_numbers(df, programs, task, input_field)
    texts = df.sparkSession.createDataFrame(list(numbers.items()), "program_no int, system_prompt string")
    return repeated.join(texts, "program_no").drop("system_hash", "program_no")


class VersionTaken(ValueError):
    """A (program_id, version) that the registry holds already."""


def save_programs(programs: DataFrame, path: str) -> None:
    """Add programs, or further versions of them, to the registry at ``path``.

    Every (program_id, version) is saved once. Each is first claimed by a marker in
    ``path/_claims``, created only if absent (atomic on local disks and HDFS), so that of two writers
    of one version one wins and the other raises ``VersionTaken`` before it writes; a frame that
    holds one version twice raises as well. Then the rows are appended. A failed write releases
    its claims; a writer killed between claim and write leaves a marker without rows, which must
    be deleted before that version can be saved.
    """
    from convoeval.operators.inference import _folder, create_once

    rows = programs.select(*schemas.PROGRAM.fieldNames())
    spark = programs.sparkSession
    keys = [(r["program_id"], r["version"]) for r in rows.select("program_id", "version").collect()]
    if len(set(keys)) != len(keys):
        raise VersionTaken("a (program_id, version) occurs more than once in the programs to save")
    claimed = []

    def release() -> None:
        for fs, place in claimed:
            fs.delete(place, False)

    for program_id, version in keys:
        name = hashlib.sha256(repr(program_id).encode()).hexdigest()[:32]
        marker = f"{path.rstrip('/')}/_claims/{name}-{version}"
        try:
            create_once(spark, marker)
        except FileExistsError as e:
            release()
            raise VersionTaken(f"program {program_id!r} version {version} is saved already") from e
        claimed.append(_folder(spark, marker))
    try:
        rows.write.mode("append").parquet(path)
    except BaseException:
        release()
        raise


def load_programs(spark: SparkSession, path: str) -> DataFrame:
    """All programs and versions of the registry."""
    return spark.read.schema(schemas.PROGRAM).parquet(path)
