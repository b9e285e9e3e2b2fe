"""Seeded samples, splits and ordered slices.

All of them find a cut first, by passes that read only the key, and then filter the table
with it. The table itself is neither sorted nor shuffled, so the cost does not depend on
how many rows are wanted. Keys are expected to be unique (``assert_unique_key``); rows
that share a key always fall on the same side of a cut. Rows without a key are not drawn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from convoeval.functions.draws import DRAW_RANGE, draw

# Rows up to which the k-th key is found by a top-k, which holds them in one task.
TOP_K = 10_000


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Raise if a key occurs twice (nulls are no keys); counts combine before the shuffle."""
    repeated = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} is not unique: {repeated[0][key]!r} occurs {repeated[0]['count']} times")
    return df


def _same_each_time(df: DataFrame) -> DataFrame:
    """Cuts are found by passes before the one that filters: all must see the same rows."""
    if not df._jdf.queryExecution().analyzed().deterministic():
        raise ValueError("the rows come from calls or draws that would be made again: store them first (materialise)")
    return df


def _boundary(draws: DataFrame, bucket: Column, wanted: Callable[[Column], Column]) -> Row:
    """One row: the bucket in which the running count reaches ``wanted``, and the counts.

    At most 65,536 bucket counts are combined, whatever the number of rows.
    """
    counts = draws.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    summed = counts.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("buckets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    ).withColumn("wanted", F.least("total", wanted(F.col("total")).cast("bigint")))
    start = F.struct(
        F.lit(None).cast("bigint").alias("bucket"),
        F.lit(0).cast("bigint").alias("before"),
        F.lit(0).cast("bigint").alias("inside"),
    )

    def step(acc: Column, b: Column) -> Column:
        return (
            F.when(acc["bucket"].isNotNull(), acc)
            .when(
                acc["before"] + b["n"] >= F.col("wanted"),
                F.struct(b["bucket"].alias("bucket"), acc["before"].alias("before"), b["n"].alias("inside")),
            )
            .otherwise(
                F.struct(
                    acc["bucket"].alias("bucket"),
                    (acc["before"] + b["n"]).alias("before"),
                    acc["inside"].alias("inside"),
                )
            )
        )

    return summed.select("wanted", "total", F.inline(F.array(F.aggregate("buckets", start, step)))).first()


def in_first_rows(
    df: DataFrame, seed: int, key: str, wanted: Callable[[Column], Column], least: int = 0
) -> Column:
    """Condition that holds for the first rows of ``df`` in the order (draw, key).

    Raises if fewer than ``least`` rows have a key.

    ``wanted`` gives the number of rows from the total number of rows. The cut is an exact
    selection by counting: by the upper half of the draw, by the lower half and, only if
    the boundary draw has to be divided, by the keys that share it. Each step is a job over
    the key column that returns one row; the condition itself compares with literals.
    """
    keys = _same_each_time(df).filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"))
    draws = keys.withColumn("h", draw(seed, F.col("key")))
    coarse = F.shiftright("h", 16)
    upper = _boundary(draws, coarse, wanted)
    if upper["total"] < least:
        raise ValueError(f"cannot draw {least} rows from {upper['total']} that have a key")
    if not upper["wanted"]:
        return F.lit(False)
    rest = upper["wanted"] - upper["before"]
    lower = _boundary(draws.filter(coarse == upper["bucket"]), F.col("h"), lambda _: F.lit(rest))
    take = rest - lower["before"]
    h = draw(seed, F.col(key))
    if take == lower["inside"]:
        return h <= lower["bucket"]
    shared = draws.filter(F.col("h") == lower["bucket"]).select("key").distinct()
    last_key = shared.orderBy("key").limit(take).agg(F.max("key").alias("key")).first()["key"]
    return (h < lower["bucket"]) | ((h == lower["bucket"]) & (F.col(key).cast("string") <= last_key))


def seeded_sample(
    df: DataFrame, n: int = 5, seed: int = 42, key: str = "conversation_id", strict: bool = False
) -> DataFrame:
    """Exactly ``n`` rows drawn without replacement, or all rows if there are fewer.

    ``strict`` raises instead when the table is too small.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    least = n if strict else 0
    return df.filter(in_first_rows(df, seed, key, lambda total: F.lit(n).cast("bigint"), least))


def train_test_split(
    df: DataFrame,
    test_size: float = 0.4,
    seed: int = 10,
    key: str = "conversation_id",
    exact: bool = True,
) -> DataFrame:
    """Add ``split``: 'test' for ceil(rows * test_size) rows, 'train' for the others.

    ``exact=False`` needs no pass over the keys: every row is decided by its own draw, and
    the test share is met on average.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if exact:
        is_test = in_first_rows(df, seed, key, lambda total: F.ceil(total * F.lit(float(test_size))))
    else:
        is_test = draw(seed, F.col(key)) < int(test_size * DRAW_RANGE)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def _kth_key(df: DataFrame, key: str, k: int) -> Column:
    """The k-th key in order (the last if there are fewer), reading the key column only.

    A small ``k`` is a top-k. A large one is located first: the keys are counted by range,
    one row per partition comes back, and the range that holds the k-th key is searched.
    """
    keys = df.select(key).filter(F.col(key).isNotNull())
    top_k = keys.orderBy(key).limit(k).agg(F.max(key)).scalar()
    if k <= TOP_K:
        return top_k
    ranges = (
        keys.repartitionByRange(key)
        .withColumn("part", F.spark_partition_id())
        .groupBy("part")
        .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
        .orderBy("low")
        .collect()
    )
    before = 0
    for found in ranges:
        if before + found["n"] < k:
            before += found["n"]
        elif found["low"] == found["high"]:
            return F.lit(found["low"])
        elif len(ranges) == 1:
            return top_k  # so few bytes that adaptive execution made one partition of them
        else:
            within = df.filter(F.col(key).between(F.lit(found["low"]), F.lit(found["high"])))
            return _kth_key(within, key, k - before)
    return F.lit(ranges[-1]["high"] if ranges else None)


def head_slice(df: DataFrame, k: int, key: str = "conversation_id") -> DataFrame:
    """The first ``k`` rows in key order."""
    if k <= 0:
        return df.filter(F.lit(False))
    return df.filter(F.col(key) <= _kth_key(df, key, k))


def tail_slice(df: DataFrame, k: int, key: str = "conversation_id") -> DataFrame:
    """All rows but the first ``k`` in key order, rows without key included. Nothing is sorted."""
    if k <= 0:
        return df
    return df.filter(F.col(key).isNull() | (F.col(key) > _kth_key(df, key, k)))
