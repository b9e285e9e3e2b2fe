"""SimHash near duplicates, found by anchor points of a covering code.

A document's fingerprint has bit i set when over half of its shingle hashes have it. Two
fingerprints link when at most ``bits`` (2) bits differ; components of links are groups.

Search: a fingerprint is two halves of 32 bits, and by pigeonhole two linked fingerprints differ
in at most one bit in one of the halves. In each half the anchors are a covering code of radius 1:
the perfect Hamming code of length 31 on the low 31 bits, the high bit free. Every half has one
home anchor (its decoding, distance at most 1) and is copied to every anchor within the covering
radius plus the half's threshold, 2: at most 17 of them. A linked pair then meets at the home
anchor of one of them, so comparing, per anchor, the fingerprints at home there with all copied
there finds every link; nothing else is compared. Equal fingerprints are one node, so that groups
of exact copies cost one row; each anchor's task sends only the edges of a spanning forest of
what it found.

Edge cases: null and empty texts, and texts of white space only, have no shingle and fingerprint 0,
and link like any other fingerprint. A null doc_id has its fingerprint and links; its component_id
is the smallest doc_id reachable, null if there is none. Repeated rows are separate documents with
equal fingerprints. Other input columns are kept; ``fingerprint`` and ``component_id`` replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from convoeval.llm.components import Union, components
from convoeval.llm.shared import WORD, join_spread, partitions_for, stored, work_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Options:
    shingle: int = 3  # words in a shingle
    bits: int = 2  # differing bits that still link
    compare: int = 4096  # fingerprints compared at once in a group


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def shingle_hashes(w: Column, words: int = 3) -> Column:
    """XXH64 (seed 42, signed) of every space-joined run of ``words`` words, repeats included.

    ``w`` must be a column of its own (not an expression): a lambda evaluates what it refers to
    once for every element.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))
    return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(hashed)


SHIFTS = np.arange(64, dtype=np.uint64)


@pandas_udf(LongType())
def majority(hashes: pd.Series) -> pd.Series:
    """Bit i is 1 where more than half of the hashes have it; no hashes give 0."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for j, h in enumerate(hashes):
        if h is None or len(h) == 0:
            continue
        a = np.asarray(h, dtype=np.int64).view(np.uint64)
        ones = ((a[:, None] >> SHIFTS[None, :]) & np.uint64(1)).sum(axis=0, dtype=np.int64)
        bits = (2 * ones > len(a)).astype(np.uint64)
        out[j] = np.bitwise_or.reduce(bits << SHIFTS)
    return pd.Series(out.view(np.int64))


def _decode(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the low 31 bits (the 1-based position of the wrong bit, 0 if none) and the home anchor."""
    syndrome = np.zeros(len(half), dtype=np.int64)
    for i in range(31):
        syndrome ^= np.where((half >> i) & 1, i + 1, 0)
    flip = np.where(syndrome > 0, np.left_shift(1, np.maximum(syndrome - 1, 0)), 0)
    return syndrome, half ^ flip


# For every syndrome s, the pairs {a, b} of positions 1..31 with a ^ b = s, a and b not s.
PAIRS = {s: [(a, a ^ s) for a in range(1, 32) if a < (a ^ s) <= 31 and a != s] for s in range(1, 32)}


def _anchors(half: int, syndrome: int, home: int) -> list[tuple[int, bool]]:
    """The anchors within distance 2 of a 32-bit half: (anchor, is home)."""
    free = 1 << 31
    if syndrome == 0:
        return [(home, True), (home ^ free, False)]
    out = [(home, True), (home ^ free, False)]
    low = half & (free - 1)
    out += [((low ^ (1 << (a - 1)) ^ (1 << (b - 1))) | (half & free), False) for a, b in PAIRS[syndrome]]
    return out


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = batch["fp"].to_numpy(dtype=np.int64)
        u = fp.view(np.uint64)
        rows = []
        for side in (0, 1):
            half = ((u >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            syndrome, home = _decode(half)
            for f, h, s, a in zip(fp.tolist(), half.tolist(), syndrome.tolist(), home.tolist()):
                rows += [(side, anchor, f, at_home) for anchor, at_home in _anchors(h, s, a)]
        yield pd.DataFrame(rows, columns=["side", "anchor", "fp", "home"])


def _linker(o: Options):
    """Links within each anchor of a task's sorted rows; a task sends its spanning forest."""

    def compare(union: Union, group: pd.DataFrame) -> None:
        every = np.unique(group["fp"].to_numpy(dtype=np.int64))
        if len(every) < 2:
            return
        homes = np.unique(group.loc[group["home"].to_numpy(dtype=bool), "fp"].to_numpy(dtype=np.int64))
        others = every.view(np.uint64)
        for start in range(0, len(homes), o.compare):
            h = homes[start : start + o.compare].view(np.uint64)
            for at in range(0, len(others), o.compare):
                near = np.bitwise_count(h[:, None] ^ others[None, at : at + o.compare]) <= o.bits
                i, j = np.nonzero(near)
                for a, b in zip(h[i].view(np.int64).tolist(), others[at + j].view(np.int64).tolist()):
                    if a != b:
                        union.join(a, b)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        union, carry = Union(), None
        for batch in batches:
            if carry is not None:
                batch = pd.concat([carry, batch], ignore_index=True)
            key = batch["side"].to_numpy(dtype=np.int64) * (1 << 33) + batch["anchor"].to_numpy(dtype=np.int64)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(batch)]
            for lo, hi in zip(bounds[:-2], bounds[1:-1]):
                if hi - lo > 1:
                    compare(union, batch.iloc[lo:hi])
            carry = batch.iloc[bounds[-2] :]
        if carry is not None and len(carry) > 1:
            compare(union, carry)
        yield pd.DataFrame(union.stars(), columns=["a", "b"])

    return link


def near_duplicates(documents: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """``documents`` with ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id reachable)."""
    spark = documents.sparkSession
    folder = work_folder(spark, "simhash")
    keep = [c for c in documents.columns if c not in ("fingerprint", "component_id", "_fp", "_w")]
    split = documents.select(*keep, words(F.col(text)).alias("_w"))
    fp = majority(shingle_hashes(F.col("_w"), options.shingle))
    printed = stored(split.select(*keep, fp.alias("_fp")), f"{folder}/printed")
    nodes = stored(
        printed.groupBy("_fp").agg(F.min("doc_id").alias("_least")).withColumnRenamed("_fp", "fp"),
        f"{folder}/nodes",
    )
    copies = nodes.select("fp").mapInPandas(_copies, "side int, anchor long, fp long, home boolean")
    parts = partitions_for(spark, nodes.count() * 34, 2_000_000)
    placed = copies.repartition(parts, "side", "anchor").sortWithinPartitions("side", "anchor")
    edges = placed.mapInPandas(_linker(options), "a long, b long")
    linked = stored(edges, f"{folder}/edges")
    roots = components(linked, f"{folder}/components")
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_fp = grouped.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    done = join_spread(printed, by_fp, "_fp")
    hexed = F.lpad(F.lower(F.hex("_fp")), 16, "0")
    return done.select(*keep, hexed.alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple], bits: int = 2) -> dict:
    """doc_id to (fingerprint, component_id) by plain Python over all pairs: for tests."""
    import re

    import xxhash

    word = re.compile(WORD)
    table = str.maketrans(UPPER, LOWER)
    prints = []
    for d, t in rows:
        w = word.findall((t or "").translate(table))
        sh = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        f = sum(1 << i for i in range(64) if 2 * sum((h >> i) & 1 for h in hs) > len(hs))
        prints.append((d, f))
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            r = root(i)
            least[r] = d if least.get(r) is None else min(least[r], d)
    return {(i, d): (f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(prints)}
