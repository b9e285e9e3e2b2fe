"""Comparing two runs over the same conversations, and several providers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.operators.backends import Backend
from convoeval.operators.inference import CallOptions, infer
from convoeval.operators.metrics import token_statistics
from convoeval.operators.prepare import key_as_string
from convoeval.operators.responses import fold_text_call
from convoeval.operators.sampling import assert_unique_key

COMPARED = ("output_transcript", "explanation", "satisfied")


def compare_runs(
    baseline: DataFrame, optimized: DataFrame, key: str = "conversation_id", check_keys: bool = False
) -> DataFrame:
    """Transcript, explanation and verdict of both runs per conversation.

    ``check_keys`` raises if a run has a key twice.
    """
    if check_keys:
        assert_unique_key(baseline, key)
        assert_unique_key(optimized, key)

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return key_as_string(df, key).select(key, *(F.col(c).alias(f"{prefix}_{c}") for c in COMPARED))

    return side(baseline, "baseline").join(side(optimized, "optimized"), key, "inner")


def switched_verdicts(compared: DataFrame) -> DataFrame:
    """Conversations whose verdict differs. Two missing verdicts do not differ."""
    return compared.filter(~F.col("baseline_satisfied").eqNullSafe(F.col("optimized_satisfied")))


def switched_summary(compared: DataFrame) -> DataFrame:
    """Number of switched conversations per optimized verdict."""
    return switched_verdicts(compared).groupBy("optimized_satisfied").agg(F.count(F.lit(1)).alias("n"))


def switched_report(compared: DataFrame, key: str = "conversation_id") -> DataFrame:
    """All switched conversations with both outputs and critiques, by direction and key."""
    return switched_verdicts(compared).orderBy("optimized_satisfied", key)


def compare_providers(
    df: DataFrame,
    backends: Mapping[str, Backend],
    input_field: str,
    system_prompt: str | Column | None = None,
    options: CallOptions = CallOptions(),
) -> DataFrame:
    """Ask every provider about every row; token statistics per provider.

    The rows are repeated per provider inside the scan stage, and the statistics combine
    before the shuffle.
    """
    asked = df.select(input_field).withColumn("provider", F.explode(F.array(*map(F.lit, sorted(backends)))))
    answers = fold_text_call(
        infer(asked, backends, F.col("provider"), input_field, system_prompt, options=options)
    )
    return token_statistics(answers, by="provider")
