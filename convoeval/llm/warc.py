"""Dictionary-compressed WARC archives.

An archive begins with a skippable frame that holds a Zstandard dictionary, trained on a bounded
sample of the records; every record after it is a frame of its own, compressed with that
dictionary. Of records with equal payloads one is the response, and the others are revisits that
carry no payload. Archives are written from the partitions of one join, whose salt spreads the
copies of a payload over tasks.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoeval.llm.shared import open_folder, stored

# Fixed values of the formats.
VERSION = "WARC/1.1"
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENDING = b"\r\n\r\n"

SALTS = 64  # parts in which the copies of one payload are dealt out
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 4_000_000  # what a dictionary is trained on, at most
DICTIONARY_BYTES = 65_536
LEVEL = 6


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", text)


def _uri(page_id) -> str:
    return f"<urn:page:{_one_line(str(page_id))}>"


def record(page_id, url: str | None, payload: bytes, digest: str, original) -> bytes:
    """One WARC record. ``original`` is the page that a revisit refers to, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if original is not None else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {_uri('null' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",  # tables of pages have no date; the field is required
        f"WARC-Target-URI: {_one_line(url or 'urn:unknown')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if original is not None:
        lines += [f"WARC-Refers-To: {_uri(original)}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(lines).encode() + ENDING + body + ENDING


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), HTTP head and payload of a record."""
    head, _, rest = raw.partition(ENDING)
    version, *lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if version != VERSION or rest[len(block) :] != ENDING:
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(ENDING)
    return fields, http, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or ENDING * 2


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def frames(archive: io.RawIOBase, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one after the other; holds one record at a time."""
    magic, size = struct.unpack("<II", archive.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive.read(size)))
    data = b""
    while True:
        data = data or archive.read(chunk)
        if not data:
            return
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else archive.read(chunk)
        yield b"".join(parts)


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, _html, _original): what a page's record refers to, null for responses.

    Of the pages with equal payloads of at least ``least`` bytes, those with the smallest page_id
    are responses. A payload's copies are dealt over ``SALTS`` parts: each part finds its minimum,
    the minima meet in one row per part, and pages join with their own part. A page without
    page_id is always a response and nothing refers to it.
    """
    html = F.coalesce("html", F.lit("")).alias("_html")
    rows = pages.select("page_id", "url", html)
    raw = F.encode("_html", "utf-8")
    rows = rows.withColumn("_sha", F.unhex(F.sha1(raw))).withColumn("_bytes", F.octet_length("_html"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    same = rows.filter((F.col("_bytes") >= least) & F.col("page_id").isNotNull())
    firsts = same.groupBy("_sha", "_salt").agg(F.min("page_id").alias("_first"))
    over = F.min("_first").over(Window.partitionBy("_sha"))
    firsts = firsts.withColumn("_first", over)
    joined = rows.join(firsts, ["_sha", "_salt"], "left")
    copy = (F.col("_bytes") >= least) & (F.col("_first") < F.col("page_id"))
    return joined.select("page_id", "url", "_html", F.when(copy, F.col("_first")).alias("_original"))


def sample_records(pages: DataFrame) -> list[bytes]:
    """Records to train on: at most so many, and so many bytes, in an order by hash of the key."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html"))
    sized = sized.withColumn("_bytes", F.octet_length("_html")).filter(F.col("_bytes") <= SAMPLE_BYTES // 16)
    draw = F.xxhash64(F.lit("record"), "page_id")
    chosen, left = {}, SAMPLE_BYTES
    for r in sized.select("page_id", "_bytes").orderBy(draw, "page_id", "_bytes").limit(SAMPLE_RECORDS).collect():
        if r["_bytes"] <= left and r["page_id"] is not None:
            left -= r["_bytes"]
            chosen[r["page_id"]] = r["_bytes"]
    if not chosen:
        return []
    keys = pages.sparkSession.createDataFrame(
        [(k, n) for k, n in chosen.items()], f"page_id {dict(pages.dtypes)['page_id']}, _bytes int"
    )
    rows = sized.join(F.broadcast(keys), ["page_id", "_bytes"]).dropDuplicates(["page_id"]).orderBy("page_id").collect()
    out = []
    for r in rows:
        payload = r["_html"].encode()
        out.append(record(r["page_id"], r["url"], payload, sha1_base32(payload), None))
    return out


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) and return (file, records), one row each.

    A null html is an empty payload. Repeated rows are archived each. Other columns are left
    behind. The returned table is written after the archives and names those that count.
    """
    dictionary = train(sample_records(pages))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out, n = f"pages-{uuid.uuid4().hex}.warc.zst", None, 0
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            if out is None and len(batch):
                fs, base = open_folder(folder)
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(skippable(dictionary))
            columns = (batch[c].tolist() for c in ("page_id", "url", "_html", "_original"))
            for page_id, url, html, original in zip(*columns):
                payload = html.encode()
                page_id, original = (None if v == "" else v for v in (page_id, original))
                out.write(pack.compress(record(page_id, url, payload, sha1_base32(payload), original)))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "records": [n]})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = decide(pages, least).select(text("page_id"), "url", "_html", text("_original"))
    return stored(rows.mapInPandas(archive, "file string, records long"), f"{folder}/written")


READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def read(written: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the archives that ``written`` names, keys as text.

    Digest and length are those of the payload that was read; for a revisit, which has none,
    those its record states. ``payloads`` returns the payloads too (null for revisits).
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                fs, base = open_folder(folder)
                with fs.open_input_stream(f"{base}/{name}", compression=None) as archive:
                    rows = []
                    for raw in frames(archive):
                        rows.append(_row(*parse(raw), payloads))
                        if len(rows) == 256:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                    yield pd.DataFrame(rows, columns=columns)

    columns = [c.split(" ")[0] for c in READ.split(", ")]
    names = written.select("file").repartition(max(1, written.sparkSession.sparkContext.defaultParallelism), "file")
    return names.mapInPandas(load, READ)


def _row(fields: dict[str, str], http: bytes, payload: bytes, payloads: bool) -> tuple:
    kind, uri = fields["warc-type"], fields["warc-record-id"]
    key = uri.removeprefix("<urn:page:").removesuffix(">")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
        original = fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")
        return None if key == "null" else key, fields["warc-target-uri"], size, stated, kind, original, None
    digest = sha1_base32(payload)
    if digest != stated:
        raise ValueError(f"payload of {uri} is damaged")
    return (
        None if key == "null" else key,
        fields["warc-target-uri"],
        len(payload),
        digest,
        kind,
        None,
        payload if payloads else None,
    )
