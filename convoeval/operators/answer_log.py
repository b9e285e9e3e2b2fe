"""An append-only log of paid answers: waves, a manifest, compaction and the current view.

Layout at ``path``::

    data/wave-00000003/   one committed Spark write: keys, ``request``, ``wave``, ``call``
    data/base-00000009/   the final answers of everything up to wave 9, written by compaction
    _manifest/00000003.wave, _manifest/00000009.base

A wave counts once its manifest entry exists. The entry is created after Spark committed the
write, and only if no entry of that number exists (Hadoop's create without overwrite), so a
killed job leaves at most a folder that no reader looks at, and two writers cannot both claim a
number. Readers take the newest base and the waves after it, in one Parquet scan of a list of
folders: the plan has the same size after 3 or 3,000 waves. When more than ``compact_after``
waves follow the base, their final answers are written as a new base; ``vacuum`` removes what
a base has replaced. Each wave's entry holds what its write observed (``DataFrame.observe``):
calls, failures, attempts and seconds, which ``wave_figures`` returns without reading answers.

``ask`` answers the rows of a frame: it asks, in ``waves`` slices by key, only the requests that
no committed wave answered successfully, and returns each row of the frame with the answer of
its *current* request. A changed prompt, model, temperature, input field or output schema is
another request; the answers of older requests stay in the log but are not returned.

Edge cases: null keys are keys like others (compared null-safely); rows repeated in the frame
are asked once and each gets the answer; a frame without rows asks nothing; a request whose
every attempt failed keeps its newest failure and is asked again by the next ``ask``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval.operators.backends import Backend
from convoeval.operators.inference import REQUEST, CallOptions, _folder, _text, create_once, infer

WAVE = "wave"
ENTRY = re.compile(r"(\d{8})\.(wave|base)")


@dataclass(frozen=True)
class LogOptions:
    waves: int = 1  # slices by key of one ask; each is committed on its own
    compact_after: int = 8  # waves after the base that make the next ask compact them


def request_key(
    provider: str | Column,
    system: str | Column | None,
    user: str,
    model_name: str | Column | None = None,
    temperature: Column | None = None,
    options: CallOptions = CallOptions(),
    schema: T.StructType | None = None,
) -> Column:
    """What an answer depends on, as a SHA-256: provider, prompts, input field, model, parameters, schema."""
    parts = {
        "provider": _text(provider),
        "system": _text(system),
        "field": F.lit(user),
        "user": F.col(user).cast("string"),
        "model_name": _text(model_name),
        "temperature": temperature if temperature is not None else F.lit(float(options.temperature)),
        "max_tokens": F.lit(options.max_tokens),
        "tries": F.lit(options.tries),
        "schema": F.lit(schema.json() if schema is not None else None).cast("string"),
    }
    fields = F.struct(*[c.alias(name) for name, c in parts.items()])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def entries(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, kind) of the manifest, in order."""
    fs, place = _folder(spark, f"{path}/_manifest")
    if not fs.exists(place):
        return []
    found = [ENTRY.fullmatch(s.getPath().getName()) for s in fs.listStatus(place)]
    return sorted((int(m.group(1)), m.group(2)) for m in found if m)


def _claim(spark: SparkSession, path: str, number: int, kind: str, figures: dict | None = None) -> None:
    """Create the manifest entry, holding ``figures`` as JSON; raises if the number is taken."""
    create_once(spark, f"{path}/_manifest/{number:08d}.{kind}", json.dumps(figures or {}).encode())


def wave_figures(spark: SparkSession, path: str) -> list[dict]:
    """What each committed wave asked, as its write observed it: no answer is read back.

    One dict per wave, in order: ``wave``, ``calls``, ``failed``, ``attempts`` and ``seconds``
    (the time the calls took, summed).
    """
    jvm, out = spark.sparkContext._jvm, []
    for number, kind in entries(spark, path):
        if kind != "wave":
            continue
        fs, place = _folder(spark, f"{path}/_manifest/{number:08d}.wave")
        stream = fs.open(place)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out.append({"wave": number, **(json.loads(text) if text else {})})
    return out


def _next_number(spark: SparkSession, path: str) -> int:
    fs, place = _folder(spark, f"{path}/data")
    used = [n for n, _ in entries(spark, path)]
    if fs.exists(place):
        used += [int(m.group(1)) for s in fs.listStatus(place) if (m := re.search(r"-(\d{8})$", s.getPath().getName()))]
    return max(used, default=0) + 1


def _live(spark: SparkSession, path: str) -> list[str]:
    """Folders that readers take: the newest base and the waves after it."""
    listed = entries(spark, path)
    base = max((n for n, kind in listed if kind == "base"), default=0)
    return [f"{path}/data/{kind}-{n:08d}" for n, kind in listed if n > base or (n == base and kind == "base")]


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """Every stored answer that counts, in one scan; None before the first wave."""
    folders = _live(spark, path)
    return spark.read.parquet(*folders) if folders else None


def final_answers(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per keys and request: its newest success, else its newest failure."""
    best = F.max_by(F.struct(*log.columns), F.struct(F.col("call.error").isNull(), F.col(WAVE))).alias("_best")
    return log.groupBy(*keys, REQUEST).agg(best).select("_best.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Write the final answers of all live folders as a base that replaces them."""
    log = read_log(spark, path)
    if log is None:
        return
    number = _next_number(spark, path)
    final_answers(log, keys).write.parquet(f"{path}/data/base-{number:08d}")
    _claim(spark, path, number, "base")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove folders and entries that the newest base replaced; returns how many folders went."""
    listed = entries(spark, path)
    base = max((n for n, kind in listed if kind == "base"), default=0)
    gone = 0
    for n, kind in listed:
        if n < base:
            fs, place = _folder(spark, f"{path}/data/{kind}-{n:08d}")
            gone += bool(fs.delete(place, True))
            fs, place = _folder(spark, f"{path}/_manifest/{n:08d}.{kind}")
            fs.delete(place, False)
    return gone


def _answered(log: DataFrame | None, keys: Sequence[str]) -> DataFrame | None:
    if log is None:
        return None
    return log.filter(F.col("call.error").isNull()).select(*[F.col(k).alias(f"_done_{k}") for k in [*keys, REQUEST]])


def _same(keys: Sequence[str], prefix: str) -> Column:
    test = F.lit(True)
    for k in [*keys, REQUEST]:
        test = test & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return test


def ask(
    df: DataFrame,
    path: str,
    backends: Mapping[str, Backend],
    provider: str | Column,
    input_field: str,
    keys: Sequence[str],
    system_prompt: str | Column | None = None,
    model_name: str | Column | None = None,
    temperature: Column | None = None,
    options: CallOptions = CallOptions(),
    schema: T.StructType | None = None,
    log_options: LogOptions = LogOptions(),
    system_prompts: Mapping[int, str] | None = None,
    request_system: Column | None = None,
) -> DataFrame:
    """The rows of ``df`` with ``request`` and ``call``; what the log lacks is asked first.

    With ``system_prompts`` (numbers in ``system_prompt``, as ``infer`` takes them) the request is
    told by ``request_system``, a column that stands for the prompt text, such as its hash.
    """
    spark = df.sparkSession
    keys = list(keys)
    system_seen = request_system if system_prompts is not None else system_prompt
    rows = df.withColumn(REQUEST, request_key(provider, system_seen, input_field, model_name, temperature, options, schema))
    for wave in range(log_options.waves):
        done = _answered(read_log(spark, path), keys)
        part = rows if log_options.waves == 1 else rows.filter(F.pmod(F.xxhash64(*keys, REQUEST), F.lit(log_options.waves)) == wave)
        todo = part if done is None else part.join(done, _same(keys, "_done_"), "left_anti")
        todo = todo.dropDuplicates([*keys, REQUEST])
        if todo.isEmpty():
            continue
        number = _next_number(spark, path)
        asked = infer(
            todo, backends, provider, input_field, system_prompt, model_name, temperature, options, schema, system_prompts
        )
        seen = Observation(f"wave-{number}")
        written = asked.select(*keys, REQUEST, F.lit(number).alias(WAVE), "call").observe(
            seen,
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("call.error").isNotNull()).alias("failed"),
            F.coalesce(F.sum("call.attempts"), F.lit(0)).cast("long").alias("attempts"),
            F.coalesce(F.sum(F.col("call.finished_at") - F.col("call.started_at")), F.lit(0.0)).alias("seconds"),
        )
        written.write.parquet(f"{path}/data/wave-{number:08d}")
        _claim(spark, path, number, "wave", seen.get)
    if sum(1 for _ in _live(spark, path)) > log_options.compact_after + 1:
        compact(spark, path, keys)
    return current(rows, path, keys)


def current(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """``rows`` (with ``request``) and the stored answer of each, null where there is none."""
    log = read_log(rows.sparkSession, path)
    keep = [c for c in rows.columns if c != "call"]
    if log is None:
        return rows.select(*keep, F.lit(None).cast(_call_type()).alias("call"))
    final = final_answers(log, keys).select(*[F.col(k).alias(f"_a_{k}") for k in [*keys, REQUEST]], "call")
    return rows.select(*keep).join(final, _same(keys, "_a_"), "left").drop(*[f"_a_{k}" for k in [*keys, REQUEST]])


def _call_type() -> T.StructType:
    from convoeval import schemas

    return schemas.CALL
