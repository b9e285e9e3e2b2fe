"""Model calls over a folder of conversation files that grows.

The text operators and the model call are row-wise, so they run on a stream as they are.
What the stream adds is the record of finished files: after a stop or a crash only the
files of the unfinished batch are asked about again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from convoeval import schemas


def answer_arrivals(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    ask: Callable[[DataFrame], DataFrame],
    schema: T.StructType = schemas.CONVERSATION,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Apply ``ask`` to every file of ``source`` once and append the rows to ``target``.

    The query takes what is there when it starts, in batches of ``files_per_batch`` files,
    and ends. Run it again for the files that came since. ``checkpoint`` must lie in a
    folder that the cluster shares.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        ask(arriving)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
