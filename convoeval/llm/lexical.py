"""Ranked lexical search over bit-sliced Bloom signatures, rescored exactly.

Every task cuts the documents it reads into blocks of ``Options.block`` rows. A block's index is
bit-sliced: ``Options.slices`` bitmaps over the rows of the block, and a document sets, for each of
its distinct terms, ``Options.hashes`` of them (the term's XXH64 cut into pieces). A query term may
occur in a document only if all its slices have the document's bit, so that the weighted sum of
the AND-ed slices, times the largest share a document of that length can give, bounds every
document's score from above. Documents are then rescored exactly in order of their bounds until
the next bound is below the ``k``-th exact score: no document that can reach the top is skipped,
and one that the bounds cannot exclude is always scored. Each task keeps its own top ``k`` per
query; the global ranking is taken from those.

The statistics that weights need (documents with terms, all their terms, each query term's
document frequency) cover all rows: every task counts its own in one pass, and Spark sums the
counts, of which there are as many as query terms. Texts are split into terms by the tasks, in
Python, once for the statistics and once for the search. The query set, with its weights, goes
to every task; it is taken in passes of at most ``Options.query_terms`` terms, so that what a
task holds does not grow with the query set.

Edge cases: a null or empty text has no terms, is not counted in N or L and never scores; a null
query text asks nothing. Rows with the same doc_id are separate documents (both may be returned);
a null doc_id takes part in all statistics and ranks after every doc_id at equal score. Only
scores above 0 are returned. Other input columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract: what a term is, the constants of the weight and the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
K1000, B_SHARE, AVG_SHARE = 1000, 75, 8  # tf * 1000 / (1000 * tf + 8 * m), m = 100 - 75 + 75 n / avg


@dataclass(frozen=True)
class Options:
    top: int = 10  # documents per query
    block: int = 2048  # documents in one bit-sliced index
    slices: int = 8192  # bitmaps of a block
    hashes: int = 2  # slices a term sets
    query_terms: int = 200_000  # distinct (query, term) rows a pass sends to the tasks


def terms(text: Column, pattern: str = TERM) -> Column:
    """The terms of a text: ``pattern`` matches after A-Z are lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(pattern), 0)


def _positions(term: str, o: Options) -> tuple[int, ...]:
    h = xxhash.xxh64_intdigest(term)
    return tuple((h >> (21 * i)) % o.slices for i in range(o.hashes))


def _block_top(block: list[tuple], queries: dict, o: Options, tops: dict, threshold: dict) -> None:
    """Score one block of (doc_id, m, n, terms) rows against all queries, updating ``tops``."""
    rows = len(block)
    counts = [Counter(t) for _, _, _, t in block]
    cache: dict[str, tuple[int, ...]] = {}
    at, who = [], []
    for j, c in enumerate(counts):
        for term in c:
            p = cache.get(term) or cache.setdefault(term, _positions(term, o))
            at.extend(p)
            who.extend([j] * len(p))
    signature = np.zeros((o.slices, rows), dtype=bool)
    if at:
        signature[np.asarray(at), np.asarray(who)] = True
    # The most that one term of weight 1 can give a document of n terms: its tf is at most n.
    n = np.array([r[2] for r in block], dtype=np.float64)
    m = np.array([r[1] for r in block], dtype=np.float64)
    share = np.floor(1e9 * n / (K1000 * n + AVG_SHARE * m)) + 1
    present: dict[str, np.ndarray] = {}
    for item, asked in queries.items():
        bound = np.zeros(rows, dtype=np.float64)
        for term, (times, weight) in asked.items():
            if weight <= 0:
                continue
            hit = present.get(term)
            if hit is None:
                p = cache.get(term) or _positions(term, o)
                hit = signature[p[0]].copy()
                for x in p[1:]:
                    hit &= signature[x]
                present[term] = hit
            bound += times * weight * hit
        bound *= share
        least = threshold.get(item, 1)
        order = np.flatnonzero(bound >= least)
        order = order[np.argsort(-bound[order], kind="stable")]
        top = tops.setdefault(item, [])
        for j in order.tolist():
            if bound[j] < threshold.get(item, 1):
                break
            doc_id, mj, _, _ = block[j]
            c = counts[j]
            score = sum(
                times * weight * ((1_000_000_000 * c[term]) // (K1000 * c[term] + AVG_SHARE * mj))
                for term, (times, weight) in asked.items()
                if c.get(term)
            )
            if score <= 0:
                continue
            key = (score, -(doc_id if doc_id is not None else 2**64), doc_id)
            if len(top) < o.top:
                heapq.heappush(top, key)
            elif key[:2] > top[0][:2]:
                heapq.heapreplace(top, key)
            if len(top) == o.top:
                threshold[item] = top[0][0]


_PATTERN = re.compile(TERM)
_LOWER = str.maketrans(UPPER, LOWER)


def tokens(text: str | None) -> list[str]:
    """The terms of one text, in Python: the same as ``terms``."""
    return _PATTERN.findall(text.translate(_LOWER)) if text else []


def _counter(wanted: frozenset):
    """Per task: documents with terms, their terms, and the documents holding each wanted term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_terms = all_terms = 0
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"].tolist():
                t = tokens(text)
                if t:
                    with_terms += 1
                    all_terms += len(t)
                    held.update(wanted.intersection(t))
        rows = [(term, n, 0) for term, n in held.items()] + [(None, with_terms, all_terms)]
        yield pd.DataFrame(rows, columns=["term", "df", "terms"])

    return count


def _searcher(queries: dict, big_n: int, big_l: int, o: Options):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict = {}
        threshold: dict = {}
        block: list[tuple] = []
        for batch in batches:
            # pandas would turn a long column with nulls into doubles: ids come without nulls.
            ids = [None if gone else i for i, gone in zip(batch["_id"].tolist(), batch["_no_id"].tolist())]
            for doc_id, text in zip(ids, batch["text"].tolist()):
                t = tokens(text)
                if not t:
                    continue
                n = len(t)
                block.append((None if doc_id is None else int(doc_id), 25 + (75 * n * big_n) // big_l, n, t))
                if len(block) >= o.block:
                    _block_top(block, queries, o, tops, threshold)
                    block = []
        if block:
            _block_top(block, queries, o, tops, threshold)
        out = [(item, doc_id, score) for item, top in tops.items() for score, _, doc_id in top]
        yield pd.DataFrame(out, columns=["item_id", "doc_id", "score"]).astype({"score": "int64"})

    return search


def search(documents: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every query with score above 0.

    ``documents`` has ``doc_id`` and ``text``, ``queries`` has ``item_id`` and ``text``. Texts are
    read twice, by tasks that split them in Python: once for the statistics of the weights, once
    for the search. The query set is taken in passes of at most ``query_terms`` (item, term) rows.
    """
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = (
        queries.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("times"))
    )
    passes = max(1, -(-asked.count() // options.query_terms))
    key = F.col("doc_id").cast("long")
    texts = documents.select(
        F.coalesce(key, F.lit(0)).alias("_id"), key.isNull().alias("_no_id"), F.col("text").cast("string").alias("text")
    )
    found = []
    for part in range(passes):
        chosen = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part) if passes > 1 else asked
        table: dict = {}
        for r in chosen.collect():
            table.setdefault(r["item_id"], {})[r["term"]] = int(r["times"])
        if not table:
            continue
        wanted = frozenset(t for asked_terms in table.values() for t in asked_terms)
        counted = texts.select("text").mapInPandas(_counter(wanted), "term string, df long, terms long")
        sums = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms")).collect()
        big_n = next((int(r["df"]) for r in sums if r["term"] is None), 0)
        big_l = next((int(r["terms"]) for r in sums if r["term"] is None), 0)
        if big_l == 0:
            return empty
        frequency = {r["term"]: int(r["df"]) for r in sums if r["term"] is not None}
        weighted = {
            item: {
                t: (times, math.floor(1000 * math.log((2.0 * big_n + 2) / (2 * frequency[t] + 1))))
                for t, times in asked_terms.items()
                if t in frequency
            }
            for item, asked_terms in table.items()
        }
        found.append(texts.mapInPandas(_searcher(weighted, big_n, big_l, options), "item_id long, doc_id long, score long"))
    if not found:
        return empty
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter(F.col("rank") <= options.top).select("item_id", "rank", "doc_id", "score")


def brute_force(rows: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    """The same ranking by plain Python over all pairs: for tests on small tables."""
    import regex

    pattern = regex.compile(TERM)
    table = str.maketrans(UPPER, LOWER)
    docs = [(d, Counter(pattern.findall((t or "").translate(table)))) for d, t in rows]
    big_n = sum(1 for _, c in docs if c)
    big_l = sum(sum(c.values()) for _, c in docs)
    df = Counter(term for _, c in docs for term in c)
    out = []
    for item, text in items:
        q = pattern.findall((text or "").translate(table))
        scored = []
        for d, c in docs:
            if not c:
                continue
            n = sum(c.values())
            m = 25 + (75 * n * big_n) // big_l
            s = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in q
                if c.get(t)
            )
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scored[:top])]
    return out
