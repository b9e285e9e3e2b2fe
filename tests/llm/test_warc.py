import base64
import hashlib
import io
from collections import Counter

import pytest
import zstandard
from convoeval.llm import warc
from convoeval.llm.shared import work_folder
from pyspark.sql import functions as F

PAGES = [
    (5, "http://a/1", "<p>same</p>"),
    (3, "http://a/2 with space\r\nX: y", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (1, "http://b", None),
    (2, "http://b", ""),
    (None, "http://c", "<p>same</p>"),
    (None, None, None),
    (7, "http://d", "é漢😀\r\n\r\nWARC/1.1\r\n" * 50),
    (8, "http://e", "long " * 200_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_html", F.lit("clash")).repartition(3)


def expected(rows):
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((k for k, _, x in rows if (x or "") == (h or "") and k is not None), default=None)
        copy = i is not None and first < i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[(i, len(raw), digest, "revisit" if copy else "response", first if copy else None)] += 1
    return out


def archived(spark, rows):
    folder = work_folder(spark, "warc-test")
    out = warc.read(warc.write(pages(spark, rows), folder), folder)
    key = F.col("page_id").cast("long")
    return Counter(map(tuple, out.select(key, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")).collect()))


def test_round_trip(spark):
    assert archived(spark, PAGES) == expected(PAGES)
    assert archived(spark, []) == Counter()


def test_many_copies_and_a_trained_dictionary(spark):
    rows = [(i, f"http://x/{i}", f"<html><body>page about {i % 90} and more words {i % 7}</body></html>" * 3) for i in range(1500)]
    assert archived(spark, rows) == expected(rows)


def test_payloads_come_back_whole(spark):
    folder = work_folder(spark, "warc-test")
    out = warc.read(warc.write(pages(spark), folder), folder, payloads=True).filter("record_type = 'response'")
    texts = {r["payload_digest"]: bytes(r["payload"]) for r in out.collect()}
    assert set(texts.values()) == {(h or "").encode() for _, _, h in PAGES}


def test_an_archive_is_a_skippable_frame_and_single_records():
    dictionary = warc.train([b"<html>%d</html>" % i * 20 for i in range(200)])
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    records = [warc.record(i, "u", b"x" * i, warc.sha1_base32(b"x" * i), None) for i in range(50)]
    raw = warc.skippable(dictionary) + b"".join(map(pack.compress, records))
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    for chunk in (1 << 16, 7, 64):
        assert list(warc.frames(io.BytesIO(raw), chunk)) == records
    with pytest.raises(ValueError, match="ends within"):
        list(warc.frames(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(records[3] + b"x")


def test_least_size_of_a_revisit(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "longer text"), (4, "u", "longer text")]
    kinds = {r["page_id"]: r["_original"] for r in warc.decide(pages(spark, rows), least=8).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: 3}
