"""Per-task sums in Arrow, and shares at the bounds of 64-bit integers."""

from collections import Counter

import pyarrow as pa
from convoeval.llm import divergence
from pyspark.sql import functions as F


def test_sums_of_a_task_go_to_arrow_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(divergence, "SENT", 2)
    texts = ["Aa aa B-é1é", "", "aa [b] ÉÀ x\x7fy@z"]
    batch = pa.record_batch([pa.array(texts), pa.array(["en", "en", "de"]), pa.array(["s", "s", "t"])], ["text", "lang", "source"])
    for flush in (1, 1000):
        c, d, parts = Counter(), Counter(), list(divergence._counter(flush)(iter([batch, batch])))
        assert all(0 < p.num_rows <= 2 for p in parts)
        for row in (r for p in parts for r in p.to_pylist()):
            key = row["lang"], row["source"], row["term"]
            c[key] += row["c"]
            d[key] += row["d"]
        want = {("en", "s", "aa"): (4, 2), ("en", "s", "b"): (2, 2), ("en", "s", "é"): (4, 2), ("en", "s", None): (0, 4), ("de", "t", None): (0, 2)}
        want.update({("de", "t", w): (2, 2) for w in ("aa", "b", "ÉÀ", "x", "y", "z")})
        assert {k: (c[k], d[k]) for k in d} == want


def test_shares_are_exact_on_both_sides_of_64_bits(spark):
    n = divergence.SMALL
    rows = [(c, t, v) for c in (0, 1, 7, n - 1, n, n + 1, 10**15) for t in (0, 3, 10**9 + 7, 10**16 + 1) for v in (0, 1, 12345)]
    rows = [r for r in rows if r[0] <= r[1]]  # a count is part of its total
    df = spark.createDataFrame(rows, "c long, t long, v long")
    got = df.select("c", "t", "v", divergence.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    for r in got:
        divisor = r.t + 2 * r.v
        assert r.p == (1 + 10**9 * (r.c + 2) // divisor if divisor else None)
