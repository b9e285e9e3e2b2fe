"""Declared schemas. Nothing in the package infers a schema from values."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOLEAN = T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    """A struct type of nullable fields, in the given order."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SEED_MESSAGE = struct(conversation_id=STRING, Text=STRING, number_of_words=LONG)
CONVERSATION = struct(conversation_id=STRING, company=STRING, conversation=STRING)

# What a model call returns for one row, before any of it is interpreted.
CALL = struct(
    response_text=STRING,
    metadata_raw=STRING,
    error=STRING,
    attempts=INT,
    started_at=DOUBLE,
    finished_at=DOUBLE,
)

STRUCTURED_VERDICT = struct(satisfied=BOOLEAN, explanation=STRING)
PROGRAM_VERDICT = struct(reasoning=STRING, satisfied=STRING)
PROGRAM_REPLY = struct(reasoning=STRING, llm_response=STRING)

# One declared shape that covers the metadata of every supported provider.
PROVIDER_METADATA = struct(
    id=STRING,
    model=STRING,
    created=LONG,
    object=STRING,
    finish_reason=STRING,
    stop_reason=STRING,
    error=STRING,
    type=STRING,
    raw=STRING,
    usage=struct(
        prompt_tokens=LONG, completion_tokens=LONG, total_tokens=LONG, input_tokens=LONG, output_tokens=LONG
    ),
    usage_metadata=struct(prompt_token_count=LONG, candidates_token_count=LONG, total_token_count=LONG),
    choices=T.ArrayType(struct(finish_reason=STRING)),
)

PROGRAM = struct(
    program_id=STRING,
    version=INT,
    task=STRING,
    instruction=STRING,
    input_desc=STRING,
    output_field=STRING,
    output_desc=STRING,
    demos=T.ArrayType(struct(input=STRING, output=STRING)),
    model_name=STRING,
    temperature=DOUBLE,
)
