"""Reading what a model answered: usage, metadata, verdicts and synthesised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval import schemas
from convoeval.functions.columns import with_computed
from convoeval.functions.text import strip
from convoeval.operators.inference import MISFIT

_CORRUPT = "_corrupt"


def parse_metadata(raw: Column) -> Column:
    """Provider metadata JSON as one declared struct + ``_corrupt``, in one pass."""
    return _checked_json(raw, schemas.PROVIDER_METADATA)


def usage_of(metadata: Column) -> Column:
    """STRUCT<input_tokens, output_tokens> from any provider's parsed metadata; 0 if absent."""
    usage, gemini = metadata["usage"], metadata["usage_metadata"]
    return F.struct(
        F.coalesce(
            usage["prompt_tokens"], usage["input_tokens"], gemini["prompt_token_count"], F.lit(0)
        ).cast("bigint").alias("input_tokens"),
        F.coalesce(
            usage["completion_tokens"], usage["output_tokens"], gemini["candidates_token_count"], F.lit(0)
        ).cast("bigint").alias("output_tokens"),
    )


def normalise_metadata(raw: Column, metadata: Column) -> Column:
    """One shape for all providers; null stays null and unreadable text gives ``error``.

    ``metadata`` is ``parse_metadata(raw)``, given as a column so that it is parsed once.
    """
    readable = metadata.isNotNull() & metadata[_CORRUPT].isNull()
    used = usage_of(metadata)
    total = F.coalesce(
        metadata["usage"]["total_tokens"],
        metadata["usage_metadata"]["total_token_count"],
        used["input_tokens"] + used["output_tokens"],
    )
    reason = F.coalesce(
        metadata["finish_reason"], F.get(metadata["choices"], F.lit(0))["finish_reason"], metadata["stop_reason"]
    )
    return F.when(
        raw.isNotNull(),
        F.struct(
            metadata["id"].alias("id"),
            metadata["model"].alias("model"),
            metadata["created"].alias("created"),
            F.struct(
                used["input_tokens"].alias("prompt_tokens"),
                used["output_tokens"].alias("completion_tokens"),
                total.alias("total_tokens"),
            ).alias("usage"),
            reason.alias("finish_reason"),
            metadata["object"].alias("object"),
            metadata["raw"].alias("raw"),
            F.when(readable, metadata["error"]).otherwise("metadata cannot be read").alias("error"),
            metadata["type"].alias("type"),
        ),
    )


def _checked_json(text: Column, schema: T.StructType) -> Column:
    """STRUCT of ``schema`` + ``_corrupt``: the text itself where it does not fit."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def add_checked_response(df: DataFrame, text_field: str, schema: T.StructType, name: str = "response") -> DataFrame:
    """Add ``name`` (STRUCT) and ``valid``: does the JSON text have every field of the schema?

    Invalid text gives a null struct. Null text is neither valid nor invalid: ``valid`` is null.
    """
    parsed = with_computed(df, "_parsed", _checked_json(F.col(text_field), schema))
    fits = F.col(f"_parsed.{_CORRUPT}").isNull()
    for field in schema.fieldNames():
        fits = fits & F.col(f"_parsed.{field}").isNotNull()
    fits = F.when(F.col(text_field).isNotNull(), fits & F.col("_parsed").isNotNull())
    struct = F.struct(*(F.col(f"_parsed.{field}").alias(field) for field in schema.fieldNames()))
    return (
        parsed.withColumn("valid", fits).withColumn(name, F.when(F.col("valid"), struct)).drop("_parsed")
    )


_OUTCOME = (
    "llm_response", "response", "llm_metadata", "metadata_raw", "input_tokens", "output_tokens", "error", "attempts"
)


def fold_text_call(df: DataFrame) -> DataFrame:
    """``call`` as the columns of ``_OUTCOME``, but for the typed ``response``.

    Columns of these names left from an earlier stage are replaced.
    """
    meta = F.col("_meta")
    used = usage_of(meta)
    return (
        df.drop(*_OUTCOME)
        .withColumn("_meta", parse_metadata(F.col("call.metadata_raw")))
        .withColumns(
            {
                "llm_response": F.col("call.response_text"),
                "llm_metadata": normalise_metadata(F.col("call.metadata_raw"), meta),
                "metadata_raw": F.col("call.metadata_raw"),
                "input_tokens": used["input_tokens"],
                "output_tokens": used["output_tokens"],
                "error": F.col("call.error"),
                "attempts": F.col("call.attempts"),
            }
        )
        .drop("_meta", "call")
    )


def fold_structured_call(df: DataFrame, schema: T.StructType = schemas.STRUCTURED_VERDICT) -> DataFrame:
    """``call`` as a typed ``response``. Text that does not fit the schema is a failed call."""
    out = add_checked_response(fold_text_call(df), "llm_response", schema)
    ok = F.coalesce(F.col("valid"), F.lit(False))
    misfit = F.when(F.col("valid") == F.lit(False), MISFIT)
    return out.withColumns(
        {
            "error": F.coalesce(misfit, "error"),
            "llm_metadata": F.when(ok, F.col("llm_metadata")),
            "metadata_raw": F.when(ok, F.col("metadata_raw")),
            "input_tokens": F.when(ok, F.col("input_tokens")).otherwise(0).cast("bigint"),
            "output_tokens": F.when(ok, F.col("output_tokens")).otherwise(0).cast("bigint"),
        }
    ).drop("valid", "llm_response")


def extract_structured_verdict(df: DataFrame, field: str = "response") -> DataFrame:
    """Add ``explanation`` and ``satisfied`` from STRUCT<satisfied BOOLEAN, explanation>."""
    return df.withColumns(
        {"explanation": F.col(f"{field}.explanation"), "satisfied": F.col(f"{field}.satisfied")}
    )


def extract_program_verdict(df: DataFrame, field: str = "response") -> DataFrame:
    """Add ``explanation`` (the reasoning) and ``satisfied`` (lower case, not stripped)."""
    return df.withColumns(
        {"explanation": F.col(f"{field}.reasoning"), "satisfied": F.lower(F.col(f"{field}.satisfied"))}
    )


def company_of(text: Column) -> Column:
    """Between the first and second colon of the first paragraph; null without a colon."""
    first = F.substring_index(text, "\n\n", 1)
    return F.when(F.contains(first, F.lit(":")), strip(F.split_part(first, F.lit(":"), F.lit(2))))


def conversation_of(text: Column) -> Column:
    """The later paragraphs joined by newlines, after their first colon.

    Blank without a later paragraph or colon there; null where the company is null.
    """
    first = F.substring_index(text, "\n\n", 1)
    rest = F.replace(
        F.substring(text, F.length(first) + 3, F.length(text)), F.lit("\n\n"), F.lit("\n")
    )
    after = F.when(F.contains(rest, F.lit(":")), F.substring(rest, F.locate(":", rest) + 1, F.length(rest)))
    return F.when(F.contains(first, F.lit(":")), strip(F.coalesce(after, F.lit(""))))


def split_company_and_conversation(df: DataFrame, field: str = "llm_response") -> DataFrame:
    """Add ``company`` and ``conversation`` from a synthesised text."""
    return df.withColumns({"company": company_of(F.col(field)), "conversation": conversation_of(F.col(field))})
