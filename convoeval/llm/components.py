"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.shared import stored


class Union:
    """Disjoint sets of integers; the root is the smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


CONTRACTED = 500_000  # edges that a task contracts at a time


def contracted(edges: DataFrame) -> DataFrame:
    """The same connectivity with fewer edges (u, v), u > v: each task joins what it sees."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        union, seen = Union(), 0
        for batch in batches:
            for a, b in zip(batch["u"].tolist(), batch["v"].tolist()):
                union.join(a, b)
            seen += len(batch)
            if seen >= CONTRACTED:
                yield pd.DataFrame(union.stars(), columns=["u", "v"])
                union, seen = Union(), 0
        yield pd.DataFrame(union.stars(), columns=["u", "v"])

    return edges.mapInPandas(contract, "u long, v long")


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the smallest one: the larger ones, or node and smaller ones.

    ``both`` has for each node ``u`` its neighbours ``v``.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node of its component.

    ``edges`` has columns ``a`` and ``b``. Rounds of large and small stars go on until nothing
    changes; each is stored in ``folder``, so that the plan does not grow with the rounds.
    """
    plain = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    now, before, turn = stored(contracted(plain), f"{folder}/round-0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, turn = mark, turn + 1
        large = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        now = stored(small, f"{folder}/round-{turn}")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
