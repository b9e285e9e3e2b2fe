"""A corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Every stage takes what its predecessor kept, written as Parquet and read again, so that a lost
executor costs at most the tasks of one stage. Rows without doc_id are judged like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.llm import jaccard, packing, quality_cnn, rules
from convoeval.llm.shared import stored, work_folder

# No stage but the first rules can be said in SQL: see the tests for brute-force versions.
ORACLE_SQL = None

REMEMBERED = 1 << 16  # words that a Python worker of the last stage holds, beside what the JVM holds of the stages before
TOGETHER = 1 << 18  # bytes of texts that it encodes at a time


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with every column but doc_id and text under a private name, and the way back.

    A stage's judge adds columns such as ``score`` or ``kept``; a user's columns of those names
    are handed on as they came.
    """
    names = {c: f"_input_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(names), back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional network does not reject (score of 0.3 or more).

    Null and empty texts are scored like others; rows with a null or repeated doc_id are judged
    each by its text; an empty table gives an empty one. The columns are those of ``docs``,
    whatever their names; a user's ``score`` or ``predicted`` is handed on unchanged.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality_cnn.train(docs, labels)
    safe, back = _aside(docs)
    return quality_cnn.score(safe, net).filter(F.col("predicted") == 1).select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep.

    Null texts have no words and fail the base rules; repeated rows are judged each by itself; an
    empty table gives an empty one. The columns are those of ``docs``; a user's columns named like
    the rules' (``n_words``, ``kept``, ``posterior``, votes) are handed on unchanged.
    """
    safe, back = _aside(docs)
    return rules.judge(safe, keep_text=True).filter("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.Options(words=5, percent=80))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED, together=TOGETHER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the result of the last one."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
