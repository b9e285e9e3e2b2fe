"""Scoring prompt programs on labelled examples and choosing the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoeval.functions.draws import draw
from convoeval.operators.metrics import exact_match, metric_score


def add_match(judged: DataFrame, prediction: str = "satisfied", gold: str = "gold_standard") -> DataFrame:
    """Add ``metric``: 1 where the program's verdict is the gold verdict, else 0."""
    return judged.withColumn("metric", exact_match(F.col(gold), F.col(prediction)))


def candidate_scores(judged: DataFrame) -> DataFrame:
    """Examples and percent score per program and version of a table with ``metric``."""
    return metric_score(judged, F.col("metric"), "program_id", "version")


def best_candidate(judged: DataFrame) -> DataFrame:
    """One row: the program and version with the best score.

    Of equal scores the earliest version wins, and of these the smallest id.
    """
    best = F.min_by(
        F.struct("program_id", "version", "examples", "score"), F.struct(-F.col("score"), "version", "program_id")
    )
    return candidate_scores(judged).agg(best.alias("best")).filter(F.col("best").isNotNull()).select("best.*")


def select_demos(
    judged: DataFrame,
    k: int = 2,
    seed: int = 101,
    key: str = "conversation_id",
    label: str = "gold_standard",
) -> DataFrame:
    """Up to ``k`` seeded demos per program, version and label from the examples it got right.

    The rank is limited to ``k``, so every task keeps ``k`` rows per group before the
    shuffle, however many rows a group has.
    """
    order = Window.partitionBy("program_id", "version", label).orderBy("_h", key)
    return (
        judged.filter(F.col("metric") == 1)
        .withColumn("_h", draw(seed, F.col(key)))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .drop("_h")
    )


def attach_demos(programs: DataFrame, demos: DataFrame, input_field: str = "transcript", output_field: str = "gold_standard") -> DataFrame:
    """Programs with their selected demos, ordered by label and rank, in place of the old ones.

    A program gets ``k`` demos per label: use it with labels of a small set, such as verdicts.
    """
    listed = demos.groupBy("program_id", "version").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(output_field).alias("o"), F.col("rank"), F.col(input_field).alias("i")))
        ).alias("_d")
    )
    shown = F.transform("_d", lambda d: F.struct(d["i"].alias("input"), d["o"].cast("string").alias("output")))
    fresh = programs.drop("demos").join(listed, ["program_id", "version"], "left")
    return fresh.withColumn("demos", F.coalesce(shown, F.array())).select(*programs.columns)
