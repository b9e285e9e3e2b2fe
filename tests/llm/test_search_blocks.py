"""Blocks that shuffle partitions of their own hold, and repeated rows."""

from collections import Counter

import numpy as np
from convoeval.llm import topk
from pyspark.sql import functions as F
from test_search import brute, search


def test_blocks_meet_without_coalescing(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        assert search(spark, rows, candidate_block=30, query_block=20) == brute(rows)
    finally:
        spark.conf.set(name, before)


def test_copies_are_candidates_and_queries_each(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(40)]
    rows += [rows[1]] * 7 + [rows[2]] + rows[5:9]
    scaled = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = Counter()
    for q, a in scaled:
        if q % 2 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in scaled if c != q)[:5]
            want.update((q, r + 1, c, -s) for r, (s, c) in enumerate(best))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for options in (topk.Options(), topk.Options(candidate_block=15, query_block=10, chunk=4)):
        got = topk.search(df, F.col("vec_id") % 2 == 0, options, copies=True)
        assert Counter(map(tuple, got.collect())) == want
