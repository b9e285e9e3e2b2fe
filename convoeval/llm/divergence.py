"""Source divergence audit: how far each source's term use lies from its language's.

For every language the kept terms are those in at least ``Options.least_docs`` of its documents.
Every (lang, source) group and every language gives each kept term a smoothed share
p = 1 + floor(10^9 (count + 2) / (N + 2V)), and f(p, q) = floor((p - q)^2 / (p + q)) measures a
difference. Two parts come out:

* ``pair``: for a group, every other source of its language, with f summed over all kept terms.
  It is computed without the groups x terms table: terms that neither source has share one p per
  group, terms of one source are summed over the histogram of its counts, and only terms that
  both have are joined, by (lang, term).
* ``term``: for a group, the ``Options.top`` kept terms that it uses more than its language does
  (p > q), by f. f grows with the group's count and falls with the language's, so a term that has
  ``top`` others with at least its group count, at most its language count and an earlier UTF-8
  spelling cannot be among them. Terms are dealt into buckets by hash; each bucket keeps its
  dominance skyband (terms dominated by fewer than ``top`` others), the skybands are merged and
  ranked exactly. A source that holds a third of all rows is spread over the buckets.

All arithmetic is exact (decimals of 38 digits where 10^9 multiplies a count). Edge cases: null
text, lang or source are read as ''; a document without terms still makes its group occur, and
such a group has p of count 0 for every kept term; a language without kept terms has pair values 0
and no term rows. Repeated rows are separate documents. Other input columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoeval.llm.shared import stored, work_folder

# Fixed values of the contract: what a term is (letters only).
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SENT = 1 << 16  # sums in a batch of Arrow
SMALL = 9_000_000_000  # counts below this, times 10^9, fit in 64 bits


@dataclass(frozen=True)
class Options:
    least_docs: int = 10  # documents of a language that a kept term is in
    top: int = 10  # ranks of the term part
    bucket_rows: int = 200_000  # candidate rows a skyband bucket is made for
    flush: int = 1_000_000  # (lang, source, term) sums a task holds before it sends them


def share(count: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(10^9 (count + 2) / (total + 2 kept)), exact; null where the divisor is 0.

    In 64-bit integers as long as they hold the product, else in decimals, which cost far more.
    """
    count, total, kept = count.cast("long"), total.cast("long"), kept.cast("long")
    big = F.lit(1_000_000_000).cast("decimal(38,0)")
    a, b = (big * (count + 2)).cast("decimal(38,0)"), (total + 2 * kept).cast("decimal(38,0)")
    # Decimal division rounds to six places; the product check puts the floor right.
    q0 = F.floor(a / b).cast("decimal(38,0)")
    q = F.when(q0 * b > a, q0 - 1).when((q0 + 1) * b <= a, q0 + 1).otherwise(q0)
    divisor = total + 2 * kept
    small = 1 + F.call_function("div", 1_000_000_000 * (count + 2), divisor)
    return F.when(divisor > 0, F.when(count < SMALL, small).otherwise(1 + q.cast("long")))


def diff(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of two columns, in 64-bit integers (p, q <= 10^9 + 1)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _skyband(top: int):
    def keep(points: pd.DataFrame) -> pd.DataFrame:
        # Terms of one (c, C) cell beyond the first ``top`` by spelling are dominated ``top`` times.
        points = points.assign(_utf8=points["term"].map(lambda t: t.encode("utf-8")))
        points = points.sort_values("_utf8", kind="stable")
        points = points.groupby(["c", "lc"], sort=False).head(top)
        c, lc = points["c"].to_numpy(np.int64), points["lc"].to_numpy(np.int64)
        kc, klc, chosen = np.empty(len(points), np.int64), np.empty(len(points), np.int64), []
        n = 0
        for i in range(len(points)):
            if n < top or np.count_nonzero((kc[:n] >= c[i]) & (klc[:n] <= lc[i])) < top:
                kc[n], klc[n] = c[i], lc[i]
                n += 1
                chosen.append(i)
        return points.iloc[chosen].drop(columns=["_utf8"])

    return keep


# The bytes of UTF-8 that terms are made of, lower-cased; others become spaces.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])


def _counter(flush: int):
    """Per task: occurrences and documents of every (lang, source, term), and documents per group.

    Terms are split and counted as UTF-8 in C, and their sums go to Arrow column by column. A task
    sends its sums whenever ``flush`` terms are held, so that its memory does not grow with its
    input. Group rows have a null term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict = {}
        holding: dict = {}
        documents: Counter = Counter()

        def part(lang: str, source: str, terms: list, c: list, d: list) -> pa.RecordBatch:
            names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            return pa.record_batch([*names, pa.array(terms, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], schema=_SUMS)

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in documents.items():
                yield part(lang, source, [None], [0], [n])
            for group, counted in occurrences.items():
                held = holding[group]
                terms = list(counted)
                for lo in range(0, len(terms), SENT):
                    own = terms[lo : lo + SENT]
                    yield part(*group, own, list(map(counted.__getitem__, own)), list(map(held.__getitem__, own)))
            occurrences.clear()
            holding.clear()
            documents.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(name).to_pylist() for name in ("text", "lang", "source"))):
                group = (lang, source)
                documents[group] += 1
                found = text.encode().translate(_TERM_BYTES).split()
                if found:
                    if group not in occurrences:
                        occurrences[group], holding[group] = Counter(), Counter()
                    occurrences[group].update(found)
                    holding[group].update(set(found))
            if sum(map(len, occurrences.values())) >= flush:
                yield from sums()
        yield from sums()

    return count


def audit(documents: DataFrame, options: Options = Options()) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``documents`` with ``text``, ``lang``, ``source``.

    The texts are read once: tasks split them into terms in Python and add up per (lang, source,
    term). The sums are dealt by (lang, term), so that each term's document count over its
    sources is a window without a further shuffle; only kept terms and the groups are stored,
    and both parts are computed from that table.
    """
    docs = documents.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    counted = docs.mapInArrow(_counter(options.flush), "lang string, source string, term string, c long, d long")
    summed = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    )
    # Over the sources of a term: documents, occurrences, and one row that stands for the term.
    sources = Window.partitionBy("lang", "term")
    keep = summed.select(
        "lang", "source", "term", "c", F.sum("c").over(sources).alias("lc"), F.sum("d").over(sources).alias("_held"),
        (F.col("source") == F.min("source").over(sources)).alias("first"),
    ).filter(F.col("term").isNull() | (F.col("_held") >= options.least_docs))
    table = stored(keep.drop("_held"), f"{work_folder(documents.sparkSession, 'divergence')}/kept")
    groups = table.filter(F.col("term").isNull()).select("lang", "source")
    used = table.filter(F.col("term").isNotNull()).select("lang", "source", "term", "c", "lc", "first")
    sizes = used.filter("first").groupBy("lang").agg(F.count("*").alias("v"))
    per_group = (
        groups.join(used.groupBy("lang", "source").agg(F.sum("c").alias("n")), ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    # Small tables that several branches read are stored once.
    folder = work_folder(documents.sparkSession, "divergence")
    per_group = stored(per_group.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"))), f"{folder}/groups")
    per_lang = per_group.groupBy("lang").agg(F.sum("n").alias("ln"), F.first("v").alias("v"))

    # Part term: the skyband of each bucket, then exact ranks.
    scored = (
        used.join(per_group.select("lang", "source", "n", "v"), ["lang", "source"])
        .join(per_lang.select("lang", "ln"), "lang")
        .withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
        .withColumn("q", share(F.col("lc"), F.col("ln"), F.col("v")))
        .filter(F.col("p") > F.col("q"))
    )
    buckets = max(1, -(-used.count() // options.bucket_rows))
    points = scored.select(
        "lang", "source", "term", "c", "lc", diff("p", "q").alias("value"),
        F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("_bucket"),
    )
    band = points.groupBy("lang", "source", "_bucket").applyInPandas(
        _skyband(options.top), "lang string, source string, term string, c long, lc long, value long, _bucket long"
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("term").cast("binary"))
    terms = (
        band.withColumn("rank", F.row_number().over(by_value).cast("int"))
        .filter(F.col("rank") <= options.top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )

    # Part pair: V f0, plus each source's own terms against the other's p0, plus shared terms.
    a = per_group.select("lang", F.col("source").alias("s1"), F.col("n").alias("n1"), F.col("p0").alias("p01"), "v")
    b = per_group.select("lang", F.col("source").alias("s2"), F.col("n").alias("n2"), F.col("p0").alias("p02"))
    pairs = a.join(b, "lang").filter(F.col("s1") != F.col("s2")).withColumn("f0", diff("p01", "p02"))
    histogram = used.groupBy("lang", "source", "c").agg(F.count("*").alias("h"))
    own = (
        histogram.withColumnRenamed("source", "s1")
        .join(pairs, ["lang", "s1"])
        .withColumn("pc", share(F.col("c"), F.col("n1"), F.col("v")))
        .groupBy("lang", "s1", "s2")
        .agg(F.sum(F.col("h") * (diff("pc", "p02") - F.col("f0"))).alias("own"))
    )
    # f(p, q) = f(q, p), so that the other source's own terms are its own row the other way round.
    own = stored(own, f"{folder}/own")
    other = own.select("lang", F.col("s2").alias("s1"), F.col("s1").alias("s2"), F.col("own").alias("other"))
    left = used.select("lang", F.col("source").alias("s1"), "term", F.col("c").alias("c1"))
    right = used.select("lang", F.col("source").alias("s2"), "term", F.col("c").alias("c2"))
    both_counts = (
        left.join(right, ["lang", "term"])
        .filter(F.col("s1") < F.col("s2"))  # the sum is the same either way
        .groupBy("lang", "s1", "s2", "c1", "c2")
        .agg(F.count("*").alias("h"))
        .join(pairs, ["lang", "s1", "s2"])
    )
    both_counts = both_counts.withColumn("p1", share(F.col("c1"), F.col("n1"), F.col("v"))).withColumn(
        "p2", share(F.col("c2"), F.col("n2"), F.col("v"))
    )
    shared = both_counts.groupBy("lang", "s1", "s2").agg(
        F.sum(F.col("h") * (diff("p1", "p2") - diff("p1", "p02") - diff("p01", "p2") + F.col("f0"))).alias("shared")
    )
    ways = F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2")))
    shared = shared.select("lang", "shared", F.inline(ways))
    total = (
        pairs.join(own, ["lang", "s1", "s2"], "left")
        .join(other, ["lang", "s1", "s2"], "left")
        .join(shared, ["lang", "s1", "s2"], "left")
        .select(
            "lang", "s1", "s2",
            F.when(
                F.col("v") > 0,
                F.col("v") * F.col("f0") + F.coalesce("own", F.lit(0)) + F.coalesce("other", F.lit(0)) + F.coalesce("shared", F.lit(0)),
            ).otherwise(F.lit(0)).cast("long").alias("value"),
        )
    )
    by_pair = Window.partitionBy("lang", "s1").orderBy(F.desc("value"), F.col("s2").cast("binary"))
    pair_rows = total.select(
        "lang", F.col("s1").alias("source"), F.lit("pair").alias("part"), F.col("s2").alias("item"), "value",
        F.row_number().over(by_pair).cast("int").alias("rank"),
    )
    return pair_rows.unionByName(terms)
