"""Best-fit packing, planned on the histogram of lengths.

Documents become pieces of at most so many tokens. The driver sees only how many pieces have each
length (as many numbers as a sequence has tokens) and plans best-fit for counts: sequences with
the same room are an interval of sequence numbers, and a step fills as many of them as there are
pieces. The plan is a table of steps: pieces of this length, of these ranks, go to these
sequences at this offset. Pieces take their slots by joining on length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoeval.llm.bpe import TOGETHER
from convoeval.llm.encode import REMEMBERED, library_encoder
from convoeval.llm.shared import partitions_for, stored, tidy, work_folder

PER_BUCKET = 20_000  # pieces that are numbered together, on average


class Step(NamedTuple):
    """Pieces of ``length`` with ranks from ``first`` to before ``last`` go to the sequences from
    ``sequence`` on, one each, at ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], size: int) -> list[Step]:
    """Best-fit decreasing over counts.

    The longest pieces come first, and each goes to the sequence with the least room in which it
    fits. Of a length, a round serves all sequences of one room at once; what it does not fill
    opens new sequences. The steps depend on the lengths that occur, hardly on their counts.
    """
    steps: list[Step] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> intervals of sequences
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, size) if open_.get(r)), size)
            each = room // length  # what a sequence takes of this length before the next one does
            if room < size:
                lo, hi = open_[room].pop()
            else:
                lo = sequences
                hi = sequences = lo + -(-left // each)
            full = min(left // each, hi - lo)
            # Sequences that take all they can; without any, one that takes the rest.
            count, pieces = (full, each) if full else (1, left)
            for k in range(pieces):
                steps.append(Step(length, rank, rank + count, lo, size - room + k * length))
                rank += count
            left -= count * pieces
            if lo + count < hi:
                open_[room].append((lo + count, hi))
            if room > pieces * length:
                open_[room - pieces * length].append((lo, lo + count))
    return steps


def pieces(
    documents: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int,
    key: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED,
    together: int = TOGETHER,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document, ``end_id`` included.

    Only documents longer than ``size`` are cut. Their pieces have ``size`` tokens but for the
    first, which has what remains. Keys travel as text, of whatever type they are.
    """
    end = np.array([end_id], np.uint32).tobytes()

    fields = [(key, pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, remembered, together)
        for batch in batches:
            rows = []
            for k, own in zip(batch.column(key).to_pylist(), encoder.encode_all(batch.column("_text"))):
                ids = np.frombuffer(own + end, np.uint32).astype("<u4").tobytes()
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % size or size
                    rows.append((k, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            columns = zip(*rows) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))

    rows = documents.select(F.col(key).cast("string").alias(key), F.coalesce(text, F.lit("")).alias("_text"))
    out = rows.mapInArrow(tidy(cut), f"`{key}` string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn(key, F.col(key).cast(dict(documents.dtypes)[key]))


def ranked(cut: DataFrame, buckets: int, key: str = "doc_id") -> DataFrame:
    """Add ``rank``, the number of a piece among those of its length.

    Pieces are numbered within (length, bucket by hash), and the counts of the buckets before are
    added, so that a length that most pieces have is not one task's work.
    """
    order = [F.col(key), F.col("piece"), F.col("ids_crc32")]
    salted = cut.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    numbered = salted.withColumn("_place", F.row_number().over(inside) - 1)
    return (
        numbered.join(sizes, ["length", "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_place"))
        .drop("_bucket", "_before", "_place")
    )


def pack(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    size: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED,
    together: int = TOGETHER,
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Returns (key, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is
    one piece of one token. Rows with the same key are packed each by itself, null keys too; an
    empty table gives no piece. Other columns are left behind. Pieces are encoded once and stored
    in the shared folder. The plan is broadcast: its size is bounded by that of the histogram.
    ``remembered`` words stay in the memory of a Python worker, which encodes ``together`` bytes of
    texts at a time; fewer take more time.
    """
    spark = documents.sparkSession
    cut = stored(pieces(documents, tokenizer, end_id, size, key, text, remembered, together), work_folder(spark, "pieces"))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    steps = plan(histogram, size)
    buckets = partitions_for(spark, sum(histogram.values()), PER_BUCKET)
    table = spark.createDataFrame(
        steps or [Step(0, 0, 0, 0, 0)], "length long, first long, last long, sequence long, offset long"
    )
    found = ranked(cut, buckets, key).join(F.broadcast(table), "length")
    found = found.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return found.select(key, "piece", "start", "length", "ids_crc32", sequence, "offset")
