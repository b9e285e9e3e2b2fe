"""Cleaning a conversation table and choosing its columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval.functions.text import strip, word_count
from convoeval.operators.language import language_tag

# The text columns in order of preference.
TEXT_COLUMNS = ("conversation", "Text")


def text_column(df: DataFrame) -> str | None:
    """The column that holds the conversation text, decided from the schema alone."""
    return next((name for name in TEXT_COLUMNS if name in df.columns), None)


def drop_blank_company(df: DataFrame) -> DataFrame:
    """Rows whose company is not the empty string. A null company is kept."""
    if "company" not in df.columns:
        return df
    return df.filter(~F.col("company").eqNullSafe(F.lit("")))


def drop_unneeded_columns(df: DataFrame, drop_empty: Iterable[str] = ("llm_response",)) -> DataFrame:
    """Drop ``llm_metadata``, and those of ``drop_empty`` that hold no text in any row.

    Each probe stops at the first row with text, so only an empty column is read whole.
    """
    gone = ["llm_metadata"]
    for name in drop_empty:
        if name in df.columns and df.filter(_holds_something(df, name)).select(name).isEmpty():
            gone.append(name)
    return df.drop(*gone)


def _holds_something(df: DataFrame, name: str) -> Column:
    """Not null and, if it is text, not empty."""
    return F.col(name) != "" if dict(df.dtypes)[name] == "string" else F.col(name).isNotNull()


def add_word_count(df: DataFrame) -> DataFrame:
    """Add ``conversation_word_count``; unchanged if the table has no text column."""
    name = text_column(df)
    return df if name is None else df.withColumn("conversation_word_count", word_count(F.col(name)))


def add_language(df: DataFrame) -> DataFrame:
    """Add ``conversation_language``; unchanged if the table has no text column."""
    name = text_column(df)
    return df if name is None else df.withColumn("conversation_language", language_tag(F.col(name)))


def preprocess(df: DataFrame, drop_empty: Iterable[str] = ("llm_response",)) -> DataFrame:
    """Blank companies out, unneeded columns out, word count and language in."""
    return add_language(add_word_count(drop_unneeded_columns(drop_blank_company(df), drop_empty)))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a name that is not there is an error, not a no-op."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumnsRenamed(dict(names))


def key_as_string(df: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The key as text. A null key stays null, so it joins with nothing."""
    return df.withColumn(key, F.col(key).cast("string"))


def labelled_examples(
    df: DataFrame, field_mapping: Mapping[str, str], key: str = "conversation_id"
) -> DataFrame:
    """Example table: mapped columns with text stripped, and ``_id = example_<key>``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [
        (strip(F.col(source)) if isinstance(types[source], T.StringType) else F.col(source)).alias(name)
        for name, source in field_mapping.items()
    ]
    return df.select(F.concat(F.lit("example_"), F.col(key).cast("string")).alias("_id"), *fields)
