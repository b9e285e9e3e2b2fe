"""Reading and writing conversation tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval import schemas
from convoeval.functions.columns import with_computed
from convoeval.functions.text import word_count


def read_conversations(
    spark: SparkSession, path: str, schema: T.StructType = schemas.CONVERSATION
) -> DataFrame:
    """Conversation table from Parquet. A missing path raises AnalysisException here."""
    return spark.read.schema(schema).parquet(path)


def ingest_seed_messages(
    raw: DataFrame,
    id_column: str = "Session Name",
    text_column: str = "Text",
    low: int = 20,
    high: int = 50,
) -> DataFrame:
    """Raw messages to seeds: non-null text of ``low <= words < high``, id renamed."""
    seeds = raw.dropna(subset=[text_column]).select(
        F.col(f"`{id_column}`").alias("conversation_id"), F.col(f"`{text_column}`").alias("Text")
    )
    counted = with_computed(seeds, "number_of_words", word_count(F.col("Text")))
    return counted.filter((F.col("number_of_words") >= low) & (F.col("number_of_words") < high))


def read_raw_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Raw messages from Parquet or from CSV with a header and quoted newlines."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    raise ValueError(f"unknown format {fmt!r}: use 'parquet' or 'csv'")


def save_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Write as Parquet, replacing what is there. Parent folders are made."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved table, lazily: no row is counted or read."""
    return spark.read.parquet(path)


def save_splits(df: DataFrame, path: str) -> None:
    """Write a table with a ``split`` column as one folder per split."""
    save_table(df, path, partition_by=["split"])


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One named split; the other folders are pruned, not read."""
    return load_table(spark, path).filter(F.col("split") == split).drop("split")


def spread(df: DataFrame) -> DataFrame:
    """A table of few splits, spread over the cores of the session; others as they are.

    Parquet is divided by row group at most, so a small table is often one task, however
    much work its rows are. A table with at least one split per two cores is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def rows_to_table(spark: SparkSession, rows: Iterable, schema: T.StructType) -> DataFrame:
    """Literal rows as a table of a declared schema."""
    return spark.createDataFrame(rows, schema)


def preview_row(df: DataFrame, key: str, position: int) -> DataFrame:
    """The row at ``position`` (from 0) in key order."""
    return df.orderBy(key).offset(position).limit(1)
