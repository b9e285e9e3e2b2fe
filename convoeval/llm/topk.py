"""Exact top-k inner products by pivot elimination.

The distance of every vector to some pivots is computed once. For a query, the pivot that shows
the largest difference of distances gives the best lower bound of the distance to a candidate,
and with the norms an upper bound of the inner product. Candidates are scored in the order of
this bound, until no other one can reach the k-th best score. Queries and candidates meet in
blocks, one pair of blocks a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoeval.llm.shared import stored, work_folder


@dataclass(frozen=True)
class Options:
    """``sample`` bounds the vectors among which the driver picks pivots."""

    k: int = 5
    scale: float = 256.0
    pivots: int = 48
    sample: int = 1000
    query_block: int = 1000
    candidate_block: int = 8000
    chunk: int = 128  # candidates scored before bounds are looked at again


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null unless every component is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")  # whole already from 2 ** 53 on, where floor would end at 2 ** 63
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return F.when(fine, F.transform(vector, whole))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as float64, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    if not np.isfinite(out).all():
        raise ValueError("vectors too long for exact inner products: scaled components are infinite")
    return out


def exact_products(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole numbers too large for float64."""
    norms = np.array([np.einsum("ij,ij->i", vectors, vectors).max(initial=0), query @ query])
    if norms.max() < 2.0**124 and norms.prod() < 2.0**124:
        return (vectors.astype(np.int64) @ query.astype(np.int64)).tolist()
    q = [int(x) for x in query.tolist()]
    return [sum(int(x) * y for x, y in zip(row, q)) for row in vectors.tolist()]


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest first: each pivot is the vector farthest from those chosen so far."""
    if not len(sample):
        return sample
    chosen = [int(np.einsum("ij,ij->i", sample, sample).argmax())]
    away = np.linalg.norm(sample - sample[chosen[0]], axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def best(query: np.ndarray, near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray,
         distances: np.ndarray, own, k: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates: highest score, then smallest id.

    ``near`` and ``distances`` are the distances of query and candidates to the pivots. Candidates
    whose products float64 may not hold exactly are all scored, in whole numbers.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        apart = np.zeros(len(ids))
        if len(near):  # less the rounding of the roots
            slack = 1e-9 * (1 + np.maximum(distances.max(axis=0, initial=0), near))
            apart = np.fmax(np.fmax.reduce(np.abs(distances - near) - slack, axis=1), 0)
        both = query @ query + norms
        bound = (both - apart * apart) / 2 + 1e-6 + 1e-12 * both
        large = ~(norms * (query @ query) < 2.0**105)
    bound[ids == own] = -np.inf
    if large.any():
        large &= ids != own
        bound[large] = -np.inf
    order = np.argsort(-bound, kind="stable")
    got_ids, got = np.zeros(0, ids.dtype), np.zeros(0)
    for lo in range(0, len(order), chunk):
        part = order[lo : lo + chunk]
        if bound[part[0]] == -np.inf or (len(got) == k and bound[part[0]] < got[-1]):
            break
        part = part[bound[part] > -np.inf]
        got_ids = np.concatenate([got_ids, ids[part]])
        got = np.concatenate([got, vectors[part] @ query])
        top = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[top], got[top]
    if large.any():
        exact = exact_products(vectors[large], query)
        scored = sorted(zip([-int(x) for x in got] + [-x for x in exact], [*got_ids, *ids[large]]))[:k]
        got_ids, got = np.array([i for _, i in scored], ids.dtype), np.array([-x for x, _ in scored], object)
    return got_ids, got


def search(
    embeddings: DataFrame, is_query: Column, options: Options = Options(), key: str = "vec_id",
    vector: str = "embedding", copies: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best candidates of each row for which ``is_query`` holds.

    Candidates are all rows but those with the query's own id. Vectors that are null or hold a
    null or non-finite component, and rows without id, take no part. Equal rows count once, with
    ``copies`` each: as candidates they take ranks of their own, as queries they return their ranks
    each. Different vectors with one id are candidates and queries each. Vectors of unequal length are
    compared as if filled with zeros. Scores are exact for vectors of any length; a score among the
    best of a block that a 64-bit integer does not hold raises an error.
    """
    o, spark = options, embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("id"), integers(F.col(vector), o.scale).alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = rows.groupBy("id", "v", "q").agg(F.count("*").alias("copies"))
    if not copies:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    head = rows.select("v").orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(o.sample)
    sample = head.toPandas()["v"]
    pivots = choose_pivots(_matrix(sample, max(map(len, sample), default=0)), o.pivots)
    kind = dict(embeddings.dtypes)[key]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            width = max([pivots.shape[1] if pivots.ndim == 2 else 0, *map(len, batch["v"])])
            x = _matrix(batch["v"], width)
            p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
            # One pivot at a time: the roots of whole numbers, without cancellation.
            d = np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in p], axis=1)
            yield batch.assign(d=list(d))

    table = stored(
        rows.mapInPandas(measure, f"id {kind}, v array<double>, q boolean, copies long, d array<double>"),
        work_folder(spark, "pivots"),
    )
    sizes = table.agg(F.count("*"), F.count_if("q")).first()
    c_blocks = max(1, -(-sizes[0] // o.candidate_block))
    q_blocks = max(1, -(-sizes[1] // o.query_block))
    placed = F.xxhash64("id", "v")

    def one_of(blocks: int) -> Column:
        return F.pmod(placed, F.lit(blocks).cast("long"))

    def all_of(blocks: int) -> Column:  # of the same type: equal numbers of two types are dealt apart
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    queries = table.filter("q").withColumn("row", F.xxhash64("v"))
    queries = queries.withColumn("qb", one_of(q_blocks)).withColumn("cb", all_of(c_blocks))
    candidates = table.withColumn("cb", one_of(c_blocks)).withColumn("qb", all_of(q_blocks))

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            c = c.loc[c.index.repeat(c["copies"].clip(upper=o.k))]  # no more can be among the best
            width = max(max(map(len, q["v"])), max(map(len, c["v"])))
            x, y = _matrix(c["v"], width), _matrix(q["v"], width)
            ids, norms = c["id"].to_numpy(), np.einsum("ij,ij->i", x, x)
            far, near = np.array(c["d"].tolist()), np.array(q["d"].tolist())
            for i, (own, row, times) in enumerate(zip(q["id"], q["row"], q["copies"])):
                got, scores = best(y[i], near[i], ids, x, norms, far, own, o.k, o.chunk)
                if any(not -(2**63) <= s < 2**63 for s in scores):
                    raise ValueError("vectors too long for exact inner products in 64 bits")
                found += [(own, row, times, a, int(s)) for a, s in zip(got, scores)]
        return pd.DataFrame(found, columns=["query_id", "row", "times", "vec_id", "score"])

    near = (
        queries.groupBy("qb", "cb")
        .cogroup(candidates.groupBy("qb", "cb"))
        .applyInPandas(block, f"query_id {kind}, row long, times long, vec_id {kind}, score long")
    )
    ranks = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= o.k)
    each = ranked.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select("query_id", "rank", "vec_id", "score")
