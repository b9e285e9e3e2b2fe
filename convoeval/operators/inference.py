"""Running a model over a table.

The call is an Arrow-batched iterator UDF. Only the prompt columns travel to Python; the
other columns of the row wait in the JVM and are joined to the answer by position, so no
key, no shuffle and no join is needed to put the answers back. The UDF is marked
non-deterministic: the optimizer neither repeats nor reorders it.

Calls cost money, so a table of answers should be written before it is used more than once:
``infer_to_table`` does that and resumes, ``materialise`` does it for a frame.
"""

from __future__ import annotations

import json
import random
import re
import sys
import tempfile
import threading
import time
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval import schemas
from convoeval.operators.backends import Backend, Client, Request, metadata_to_json

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


@dataclass(frozen=True)
class CallOptions:
    """How requests are made. ``partitions`` times ``threads`` is the concurrency cap.

    ``calls_per_second`` caps the attempts of the whole job, failed ones too. It needs
    ``partitions``: each task gets its share, so the cap holds however many run at a time.
    """

    temperature: float = 0.0
    max_tokens: int = 2048
    tries: int = 3
    backoff_base: float = 2.0
    backoff_cap: float = 60.0
    threads: int = 1
    partitions: int | None = None
    calls_per_second: float | None = None

    def __post_init__(self):
        if self.calls_per_second and not self.partitions:
            raise ValueError("calls_per_second needs partitions, over which it is divided")


class _Pace:
    """Lets one task's attempts through at even distances, whichever thread makes them."""

    def __init__(self, options: CallOptions):
        self.gap = options.partitions / options.calls_per_second if options.calls_per_second else 0.0
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(self.next, time.monotonic())
                self.next = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


MISFIT = "response does not fit the schema"
_PLAIN = {"boolean": bool, "bigint": int, "int": int, "double": (int, float)}


def fits(text: str | None, schema: T.StructType) -> bool:
    """Is the text a JSON object that has every field of the schema, of its type and not null?"""
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return False
    if not isinstance(found, dict):
        return False
    for field in schema.fields:
        kind, value = _PLAIN.get(field.dataType.simpleString()), found.get(field.name)
        if value is None or (kind and not isinstance(value, kind)) or (kind not in (None, bool) and isinstance(value, bool)):
            return False
    return True


def _wait(options: CallOptions, attempt: int) -> float:
    """Seconds before the next attempt: exponential, capped, with full jitter."""
    if not options.backoff_base:
        return 0.0
    return random.uniform(0, min(options.backoff_cap, options.backoff_base ** (attempt - 1)))


def call_with_retry(
    client: Client, request: Request, options: CallOptions, schema: T.StructType | None = None, pace: _Pace | None = None
) -> dict:
    """One CALL row. A request that fails every time gives an error, never an exception.

    With a schema, an answer that does not fit it is a failed attempt like any other.
    """
    started, error = time.time(), None
    for attempt in range(1, options.tries + 1):
        if pace:
            pace.wait()
        try:
            reply = client({**request, "attempt": attempt})
            if schema is not None and not fits(reply["text"], schema):
                raise _Misfit
            return {
                "response_text": reply["text"],
                "metadata_raw": metadata_to_json(reply.get("metadata")),
                "error": None,
                "attempts": attempt,
                "started_at": started,
                "finished_at": time.time(),
            }
        except _Misfit:
            error = MISFIT
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if attempt < options.tries:
            time.sleep(_wait(options, attempt))
    return _failed(error, options.tries, started)


class _Misfit(Exception):
    """The answer has another shape than was asked for."""


def _failed(error: str, attempts: int, started: float) -> dict:
    return {
        "response_text": None,
        "metadata_raw": None,
        "error": error,
        "attempts": attempts,
        "started_at": started,
        "finished_at": time.time(),
    }


def _caller(
    backends: Mapping[str, Backend],
    options: CallOptions,
    schema: T.StructType | None,
    system_prompts: Mapping[int, str] | None = None,
):
    """The UDF (provider, system, user, model_name, temperature) -> CALL.

    With ``system_prompts`` the system column holds numbers, looked up in that dictionary,
    which travels with the task once instead of with every row.
    """

    def call(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.DataFrame]:
        clients: dict[str, Client] = {}  # one per provider and task
        pace = _Pace(options)

        def one(row: tuple) -> dict:
            provider, system, user, model_name, temperature = row
            if system_prompts is not None and system is not None:
                system = system_prompts[int(system)]
            if user is None or provider not in clients:
                return _failed("no input" if user is None else f"unknown provider: {provider}", 0, time.time())
            request = {
                "provider": provider,
                "system": system,
                "user": user,
                "model_name": model_name,
                "temperature": None if pd.isna(temperature) else temperature,
                "max_tokens": options.max_tokens,
            }
            return call_with_retry(clients[provider], request, options, schema, pace)

        with ThreadPoolExecutor(options.threads) as pool:
            for batch in batches:
                for name in batch[0].unique():
                    if name in backends and name not in clients:
                        clients[name] = _client_of(backends[name])
                yield pd.DataFrame(list(pool.map(one, zip(*batch))), columns=schemas.CALL.fieldNames())

    return F.pandas_udf(call, schemas.CALL).asNondeterministic()


def _client_of(backend: Backend) -> Client:
    """The backend's client. If it cannot be made, every request reports why."""
    try:
        return backend()
    except Exception as e:
        message = f"client setup failed: {type(e).__name__}: {e}"

        def broken(_: Request) -> dict:
            raise RuntimeError(message)

        return broken


def infer(
    df: DataFrame,
    backends: Mapping[str, Backend],
    provider: str | Column,
    input_field: str,
    system_prompt: str | Column | None = None,
    model_name: str | Column | None = None,
    temperature: Column | None = None,
    options: CallOptions = CallOptions(),
    schema: T.StructType | None = None,
    system_prompts: Mapping[int, str] | None = None,
) -> DataFrame:
    """Add ``call``, the raw outcome of one model call per row.

    With ``system_prompts``, ``system_prompt`` is a column of numbers into that dictionary.

    With ``schema`` an answer must be a JSON object that fits it; another one is tried again.

    ``provider`` names the backend: a name that is not registered is rejected here. As a
    column it is looked up per row, and an unknown name gives an error row.
    """
    if isinstance(provider, str):
        if provider not in backends:
            raise ValueError(f"unknown provider {provider!r}: use one of {sorted(backends)}")
        backends, provider = {provider: backends[provider]}, F.lit(provider)
    if options.partitions:
        df = df.repartition(options.partitions)
    return df.withColumn(
        "call",
        _caller(backends, options, schema, system_prompts)(
            provider.cast("string"),
            _text(system_prompt),
            F.col(input_field).cast("string"),
            _text(model_name),
            temperature if temperature is not None else F.lit(float(options.temperature)),
        ),
    )


def _text(value: str | Column | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Run ``df`` once and return the stored result, so that later uses do not run it again.

    With a path the rows are written there as Parquet. Without one they go to the
    session's checkpoint folder, which survives the loss of executors.
    """
    spark = df.sparkSession
    if path is not None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names, or that this session has set.

    Only a local session that has neither gets a folder of its own, once.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or give a path")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="convoeval-"))
    return context.getCheckpointDir()


REQUEST = "request"


def request_hash(
    provider: str | Column,
    system: str | Column | None,
    user: str | Column,
    model_name: str | Column | None = None,
    temperature: Column | None = None,
    options: CallOptions = CallOptions(),
) -> Column:
    """What an answer depends on, as a hash: provider, prompts, model and its parameters."""
    parts = {
        "provider": _text(provider),
        "system": _text(system),
        "user": (F.col(user) if isinstance(user, str) else user).cast("string"),
        "model_name": _text(model_name),
        "temperature": temperature if temperature is not None else F.lit(float(options.temperature)),
        "max_tokens": F.lit(options.max_tokens),
    }
    fields = F.struct(*[c.alias(name) for name, c in parts.items()])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _folder(spark: SparkSession, path: str):
    """The folder as Hadoop's file systems see it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def create_once(spark: SparkSession, path: str, content: bytes = b"") -> None:
    """Create a file that must not exist yet; raises ``FileExistsError`` if it does.

    On local disks this is ``O_CREAT | O_EXCL``, atomic; elsewhere Hadoop's create without
    overwrite, which is atomic on HDFS (object stores give no such promise).
    """
    fs, place = _folder(spark, path)
    qualified = fs.makeQualified(place)
    if qualified.toUri().getScheme() == "file":
        import os

        local = qualified.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        try:
            os.write(handle, content)
        finally:
            os.close(handle)
        return
    try:
        out = fs.create(place, False)
    except Exception as e:
        raise FileExistsError(path) from e
    out.write(bytearray(content))
    out.close()


def committed_runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs at ``path`` that ended, from the folder names alone."""
    fs, place = _folder(spark, path)
    if not fs.exists(place):
        return []
    found = []
    for entry in fs.listStatus(place):
        number = re.fullmatch(r"run=(\d+)", entry.getPath().getName())
        if number and fs.exists(_folder(spark, f"{path}/{entry.getPath().getName()}/_SUCCESS")[1]):
            found.append(int(number.group(1)))
    return sorted(found)


def final_answers(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys and request: its success, or else its newest failure.

    Null keys are keys like others. The choice is a maximum per group, which tasks combine
    before the shuffle. Columns of different runs are those of the newest one.
    """
    best = F.max_by(F.struct(*runs.columns), F.struct(F.col("call.error").isNull(), "run")).alias("_best")
    return runs.groupBy(*keys, REQUEST).agg(best).select("_best.*").drop("run")


def unanswered(df: DataFrame, answered: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose request has no successful answer yet, null keys compared as equal."""
    if answered is None:
        return df
    names = [*keys, REQUEST]
    done = answered.filter(F.col("call.error").isNull()).select(*[F.col(n).alias(f"_done_{n}") for n in names])
    same = [F.col(n).eqNullSafe(F.col(f"_done_{n}")) for n in names]
    return df.join(done, same, "left_anti")


def infer_to_table(
    df: DataFrame,
    path: str,
    backends: Mapping[str, Backend],
    provider: str | Column,
    input_field: str,
    keys: list[str],
    system_prompt: str | Column | None = None,
    model_name: str | Column | None = None,
    temperature: Column | None = None,
    options: CallOptions = CallOptions(),
    schema: T.StructType | None = None,
    waves: int = 1,
) -> DataFrame:
    """Answer every row of ``df``, store the answers at ``path`` and return all that are stored.

    A row is told by its ``keys`` and the hash of its request, in the added column
    ``request``: another prompt, model or temperature is another request. Rows that agree in
    both are asked once. Each run asks only what no earlier run answered, and is a committed
    folder of its own; ``waves`` divides a run by key into so many of them, of which those
    that ended survive a failure. The result has one row per keys and request of any run.
    """
    spark = df.sparkSession
    df = df.withColumn(
        REQUEST, request_hash(provider, system_prompt, input_field, model_name, temperature, options)
    )
    for wave in range(waves):
        numbers = committed_runs(spark, path)
        earlier = _read_runs(spark, path, numbers) if numbers else None
        part = df.filter(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave) if waves > 1 else df
        todo = unanswered(part, earlier, keys).dropDuplicates([*keys, REQUEST])
        asked = infer(
            todo, backends, provider, input_field, system_prompt, model_name, temperature, options, schema
        )
        asked.write.mode("overwrite").parquet(f"{path}/run={numbers[-1] + 1 if numbers else 0}")
    return final_answers(_read_runs(spark, path, committed_runs(spark, path)), keys)


def _read_runs(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The committed runs, with the number of the run; columns that a run lacks are null."""
    parts = [spark.read.parquet(f"{path}/run={n}").withColumn("run", F.lit(n)) for n in numbers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def without_waits(options: CallOptions = CallOptions()) -> CallOptions:
    """The same options without pauses between attempts, for rule backends."""
    return replace(options, backoff_base=0.0)
