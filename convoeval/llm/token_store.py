"""Token ids in binary shards, and an index of minimal perfect hashes over their keys.

Shard: 16 bytes of header (magic, width of an id), the raw ids of its documents in ascending
key order, then one 64-bit count of ids per document, then the number of documents. Index file: a
minimal perfect hash of the keys whose hash falls into one bucket, and for each slot a
fingerprint of the key, the shard, the number of the document in it and how many follow with the
same key. A key is found by one hash and one look at a slot; no key is stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.llm.encode import library_encoder, vocabulary_size
from convoeval.llm.shared import map_file, open_folder, stored

SHARD, INDEX = b"TOKSHARD", b"TOKINDEX"
KEYS_PER_BUCKET = 1 << 16
LEVELS, ROOM = 40, 2  # levels of the hash, and bits of a level for each key it gets


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the same keys for each level."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit hashes to 0 .. n-1 without gaps.

    Each level is a bit array in which a key owns its bit if no other key wants it; the others go
    on to the next level. The number of a key is the rank of its bit. Keys left after the last
    level, which needs an unlikely accident, are listed.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ones = np.unpackbits(bits, bitorder="little")
        self.rank = np.cumsum(ones, dtype=np.int64) - ones
        self.ones = ones
        self.listed = int(ones.sum())

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], h
        for level in range(LEVELS):
            if not len(left):
                break
            m = -(-ROOM * len(left) // 8) * 8
            at = (_mixed(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels or [np.zeros(0, np.uint8)]), np.sort(left))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for one that cannot be among them."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level, m in enumerate(self.sizes):
            at = self.starts[level] + (_mixed(h[todo], level) % np.uint64(m)).astype(np.int64)
            hit = self.ones[at] == 1
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, h[todo]), len(self.rest) - 1)
            hit = self.rest[at] == h[todo]
            out[todo[hit]] = self.listed + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQ", len(self.sizes), len(self.rest))
        return head + self.sizes.astype("<i8").tobytes() + self.rest.astype("<u8").tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, raw) -> tuple[PerfectHash, int]:
        n, listed = struct.unpack_from("<QQ", raw)
        sizes = np.frombuffer(raw, "<i8", n, 16)
        rest = np.frombuffer(raw, "<u8", listed, 16 + 8 * n)
        at, size = 16 + 8 * n + 8 * listed, int(sizes.sum()) // 8
        return cls(sizes, np.frombuffer(raw, np.uint8, size, at), rest), at + size


SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("run", "<u4")])


def _hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes of a key of any type; null is a key like any other."""
    return [F.xxhash64(key).alias("_h"), F.xxhash64(F.lit("print"), key).alias("_p")]


def write_shards(documents: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, append ``end_id``, write the shards and return one row per document.

    Shards are ranges of the key, so that shard number and place give ascending key order; null
    keys come first, and repeated keys are in one shard, in the order of their texts.
    """
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], np.uint32).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(tokenizer), TaskContext.get().partitionId()
        name, fs_base, counts = f"shard-{uuid.uuid4().hex}", None, []
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                fs, fs_base = open_folder(folder)
                fs.create_dir(fs_base, recursive=True)
                out = fs.open_output_stream(f"{fs_base}/{name}", compression=None)
                out.write(SHARD + struct.pack("<Q", width))
            first, got = len(counts), []
            for own in encoder.encode_all(batch.column("_text")):
                ids = np.frombuffer(own + end, np.uint32)
                out.write(ids.astype(f"<u{width}").tobytes())
                got.append(len(ids))
            counts += got
            numbers = [pa.array(x, pa.int64()) for x in ([shard] * len(got), range(first, len(counts)), got)]
            files = pa.array([name] * len(got), pa.string())
            own = [batch.column("_h"), batch.column("_p"), numbers[0], files, *numbers[1:]]
            yield pa.RecordBatch.from_arrays(own, ["_h", "_p", "shard", "file", "number", "n"])
        if out is not None:
            out.write(np.array(counts, "<u8").tobytes() + struct.pack("<Q", len(counts)))
            out.close()

    rows = documents.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.repartitionByRange("_key").sortWithinPartitions("_key", "_text").select(*_hashes(F.col("_key")), "_text")
    schema = "_h long, _p long, shard long, file string, number long, n long"
    return stored(rows.mapInArrow(write, schema), f"{folder}/written")


def write_index(written: DataFrame, folder: str) -> DataFrame:
    """Write the index files and return (bucket, file); a bucket holds so many keys at most on average."""
    buckets = max(1, -(-written.count() // KEYS_PER_BUCKET))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["_h"].to_numpy(np.int64).view(np.uint64)
        found = PerfectHash.build(h)
        slots = np.zeros(len(h), SLOT)
        at = found(h)
        slots["print"][at] = pdf["_p"].to_numpy(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
        for name in ("shard", "first", "run"):
            slots[name][at] = pdf[name].to_numpy()
        name = f"index-{uuid.uuid4().hex}"
        fs, base = open_folder(folder)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(INDEX + struct.pack("<Q", len(h)) + found.to_bytes() + slots.tobytes())
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "index_file": [name]})

    keys = written.groupBy("_h", "_p").agg(
        F.min("shard").alias("shard"), F.min("number").alias("first"), F.count("*").alias("run")
    )
    keys = keys.withColumn("bucket", F.pmod("_h", F.lit(buckets)))
    return stored(keys.groupBy("bucket").applyInPandas(build, "bucket long, index_file string"), f"{folder}/indexed")


def look_up(keys: DataFrame, indexed: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Where the documents of each key are: (key, shard, first, run), keys as text.

    Unknown keys have no row. Text, since pandas has no exact whole numbers beside nulls.
    """
    buckets = max(1, indexed.count())

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = map_file(folder, pdf["index_file"].iloc[0])
        (n,) = struct.unpack_from("<Q", raw, 8)
        found, used = PerfectHash.from_bytes(raw[16:])
        slots = np.frombuffer(raw, SLOT, n, 16 + used)
        at = found(pdf["_h"].to_numpy(np.int64).view(np.uint64))
        prints = (pdf["_p"].to_numpy(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        known = at >= 0
        known[known] = slots["print"][at[known]] == prints[known]
        out = pdf.loc[known, [key]].copy()
        for name in ("shard", "first", "run"):
            out[name] = slots[name][at[known]].astype(np.int64)
        return out

    asked = keys.select(F.col(key).cast("string").alias(key), *_hashes(F.col(key)))
    asked = asked.withColumn("bucket", F.pmod("_h", F.lit(buckets)))
    asked = asked.join(indexed, "bucket")
    return asked.groupBy("bucket").applyInPandas(find, f"`{key}` string, shard long, first long, run long")


def shard_bases(written: DataFrame) -> DataFrame:
    """(shard, file, base): the ids in all shards before. One row per shard goes through the driver."""
    sizes = written.groupBy("shard", "file").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes], dtype=np.int64)])
    rows = [(r["shard"], r["file"], int(b)) for r, b in zip(sizes, before)]
    return written.sparkSession.createDataFrame(rows, "shard long, file string, base long")


def read_documents(found: DataFrame, bases: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Read the ids of looked-up documents: (key, start, n_tokens, ids_crc32), one row per document."""

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = map_file(folder, pdf["file"].iloc[0])
        (width,) = struct.unpack_from("<Q", raw, 8)
        (n,) = struct.unpack_from("<Q", raw, len(raw) - 8)
        counts = np.frombuffer(raw, "<u8", n, len(raw) - 8 - 8 * n).astype(np.int64)
        start = np.cumsum(counts) - counts
        rows = []
        for k, first, run, base in zip(pdf[key], pdf["first"], pdf["run"], pdf["base"]):
            for i in range(first, first + run):
                ids = np.frombuffer(raw, f"<u{width}", counts[i], 16 + width * start[i])
                rows.append((k, base + start[i], counts[i], zlib.crc32(ids.astype("<u4").tobytes())))
        return pd.DataFrame(rows, columns=[key, "start", "n_tokens", "ids_crc32"])

    placed = found.join(bases, "shard")
    return placed.groupBy("shard").applyInPandas(read, f"`{key}` string, start long, n_tokens long, ids_crc32 long")


def write_and_read(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write shards and index below ``folder``, then read every document back through the index.

    A null text is empty: its only id is ``end_id``. A null key is a key like any other; rows with
    the same key are all stored and all returned. An empty table gives no shard and no row.
    """
    written = write_shards(documents, folder, tokenizer, end_id, key, text)
    indexed = write_index(written, folder)
    found = look_up(documents.select(key).distinct(), indexed, folder, key)
    read = read_documents(found, shard_bases(written), folder, key)
    return read.withColumn(key, F.col(key).cast(dict(documents.dtypes)[key]))
