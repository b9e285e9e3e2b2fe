"""What several of these operators need: a shared work folder, its files, keyed subsets.

Work files go below ``spark.checkpoint.dir``, the folder that driver and executors share.
Files that are not tables (archives, token shards, tries) are written through Arrow's file
systems under a name that no other attempt of the same task uses; a table of the attempts
that Spark committed says which of them count, so lost executors leave at most unused files.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.operators.inference import checkpoint_dir

# The white space of the contracts (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder, named but not yet made, in the folder that the cluster shares.

    The name is qualified on the driver as Hadoop resolves it (a path without a scheme is on
    ``fs.defaultFS``), so that Arrow's file systems on the executors open the same place.
    """
    base = checkpoint_dir(spark).rstrip("/")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    qualified = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if qualified.startswith("file:/") and not qualified.startswith("file:///"):
        qualified = "file:///" + qualified[len("file:/") :].lstrip("/")
    return f"{qualified.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Run ``df`` once, write it as Parquet at ``path`` and read it from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it.

    Folders of ``work_folder`` carry their scheme; a plain path (only in tests) is local.
    """
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, *parts: bytes) -> int:
    """Write one file and return its size."""
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    size = 0
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return size


def map_file(folder: str, name: str) -> memoryview:
    """A file's bytes: mapped where the folder is local to this machine, else read."""
    fs, base = open_folder(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return memoryview(pa.memory_map(f"{base}/{name}").read_buffer())
    with fs.open_input_file(f"{base}/{name}") as f:
        return memoryview(f.read_buffer())


def give_back() -> None:
    """Return to the system what this process has freed.

    A Python worker serves many tasks of many stages. What its allocators keep of one of them lies
    beside the work of all others on the machine. Only the GNU C library needs to be asked.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, from batches to batches, giving back freed memory before it, after each batch and at its end."""

    def each(batches: Iterable) -> Iterator:
        give_back()
        for batch in batches:
            yield batch
            del batch
            give_back()

    @wraps(task)
    def run(batches):
        try:
            yield from task(each(batches))
        finally:
            give_back()

    return run


def crc_class(key: Column, classes: int) -> Column:
    """CRC-32 of the key's decimal text, modulo ``classes``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % classes


def held_out(key: Column, classes: int, left_out: int) -> Column:
    """True for rows that training must not see. A row without a key is one of them."""
    return F.coalesce(crc_class(key, classes) == left_out, F.lit(True))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions for ``rows``, and no fewer than the session's shuffles use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int
) -> list[tuple[bytes, int]]:
    """Texts and labels to train on: at most ``rows`` of them and ``most_bytes`` of text.

    Whole texts of documents that are not held out (modulo 5), in an order by hash, so that the
    sample does not depend on how the table is laid out. A text that would exceed the bound is
    passed over. The first pass sees only keys and lengths; the second fetches the chosen texts.
    """
    doc, y = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), F.col(label).cast("int")
    wanted = labels.filter(y.isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", y.alias("_y")).distinct()
    draw = F.xxhash64(F.lit("sample"), "doc_id")
    sized = doc.select("doc_id", F.octet_length("_text").alias("_bytes")).join(wanted, "doc_id")
    first = sized.orderBy(draw, "doc_id", "_y", "_bytes").limit(rows).collect()
    chosen, left = {}, most_bytes
    for r in first:
        if r["_bytes"] <= left:
            left -= r["_bytes"]
            chosen.setdefault(r["doc_id"], []).append((r["_bytes"], r["_y"]))
    if not chosen:
        return []
    # One text per chosen (key, size), the smallest: the driver gets at most ``rows`` texts.
    wanted_keys = sorted({(k, size) for k, uses in chosen.items() for size, _ in uses})
    keys = documents.sparkSession.createDataFrame(wanted_keys, f"doc_id {dict(documents.dtypes)['doc_id']}, _bytes int")
    sized_texts = doc.select("doc_id", "_text", F.octet_length("_text").alias("_bytes"))
    picked = sized_texts.join(F.broadcast(keys), ["doc_id", "_bytes"]).groupBy("doc_id", "_bytes").agg(F.min("_text").alias("_text"))
    texts = {(r["doc_id"], r["_bytes"]): r["_text"].encode() for r in picked.collect()}
    out = []
    for k, uses in chosen.items():
        for size, label_value in uses:
            if (k, size) in texts:
                out.append((texts[(k, size)], label_value))
    return out


def join_spread(rows: DataFrame, values: DataFrame, key: str, how: str = "left", salts: int = 64) -> DataFrame:
    """Join ``values``, one row per key, to ``rows``, of which one key may have a large share.

    Rows are dealt over ``salts`` parts of their key, and only the parts that occur are joined.
    """
    others = [c for c in rows.columns if c != key]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
    parts = salted.select(key, "_salt").distinct().join(values, key)
    return salted.join(parts, [key, "_salt"], how).drop("_salt")
