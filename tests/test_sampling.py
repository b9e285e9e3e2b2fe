import pytest
from pyspark.sql import functions as F

from convoeval.operators import sampling
from models import draw


def table(spark, n, partitions=4):
    return spark.range(n).select(F.col("id").cast("string").alias("conversation_id"), (F.col("id") * 2).alias("v")).repartition(partitions)


def ids(df):
    return sorted(r["conversation_id"] for r in df.collect())


def ordered(n, seed):
    return sorted(map(str, range(n)), key=lambda k: (draw(seed, k), k))


@pytest.mark.parametrize("n", [0, 1, 5, 399, 400, 1000])
def test_sample_is_exact(spark, n):
    assert ids(sampling.seeded_sample(table(spark, 400), n, seed=10)) == sorted(ordered(400, 10)[:n])


def test_strict_sample_and_bad_arguments(spark):
    assert sampling.seeded_sample(table(spark, 10), 10, strict=True).count() == 10
    with pytest.raises(ValueError):
        sampling.seeded_sample(table(spark, 10), 11, strict=True)
    with pytest.raises(ValueError):
        sampling.seeded_sample(table(spark, 10), -1)


@pytest.mark.parametrize("partitions", [1, 17])
def test_split_of_400_is_240_and_160(spark, partitions):
    split = sampling.train_test_split(table(spark, 400, partitions), 0.4, seed=10)
    test = ids(split.filter("split = 'test'"))
    assert test == sorted(ordered(400, 10)[:160])
    assert split.filter("split = 'train'").count() == 240


def test_boundary_draw_is_divided_by_key(spark, monkeypatch):
    """With few possible draws many keys share the boundary draw."""
    monkeypatch.setattr(sampling, "draw", lambda seed, key: F.length(key.cast("string")).cast("bigint"))
    got = ids(sampling.seeded_sample(table(spark, 200), 50))
    assert got == sorted(sorted(map(str, range(200)), key=lambda k: (len(k), k))[:50])


def test_equal_keys_stay_together(spark):
    hot = table(spark, 300).withColumn("conversation_id", F.when(F.col("v") < 200, "hot").otherwise(F.col("conversation_id")))
    split = sampling.train_test_split(hot, 0.4, seed=3)
    assert split.filter("conversation_id = 'hot'").select("split").distinct().count() == 1
    assert split.count() == 300
    with pytest.raises(ValueError):
        sampling.assert_unique_key(hot, "conversation_id")
    assert sampling.assert_unique_key(table(spark, 5), "conversation_id").count() == 5


def test_missing_keys_and_empty_tables(spark):
    df = table(spark, 20).withColumn("conversation_id", F.when(F.col("v") > 10, F.col("conversation_id")))
    assert sampling.seeded_sample(df, 100).count() == 14
    assert sampling.train_test_split(df.filter("false"), 0.4).count() == 0


def test_hash_split_is_near_its_share(spark):
    split = sampling.train_test_split(table(spark, 5000), 0.4, exact=False)
    assert abs(split.filter("split = 'test'").count() / 5000 - 0.4) < 0.03


def test_slices(spark):
    df = table(spark, 50)
    order = sorted(map(str, range(50)))
    assert ids(sampling.head_slice(df, 7)) == order[:7]
    assert ids(sampling.tail_slice(df, 7)) == order[7:]
    assert sampling.head_slice(df, 0).count() == 0 and sampling.tail_slice(df, 0).count() == 50
    assert sampling.head_slice(df, 99).count() == 50 and sampling.tail_slice(df, 99).count() == 0


@pytest.mark.parametrize("k", [1, 3, 20, 57, 300, 499, 500, 900])
def test_long_slices_are_located_by_range(spark, monkeypatch, k):
    monkeypatch.setattr(sampling, "TOP_K", 3)
    order = sorted(map(str, range(500)))
    assert ids(sampling.head_slice(table(spark, 500), k)) == order[:k]
    assert ids(sampling.tail_slice(table(spark, 500), k)) == order[k:]


def test_long_slice_of_a_hot_key_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TOP_K", 3)
    hot = table(spark, 300).withColumn("conversation_id", F.when(F.col("v") < 200, "5").otherwise(F.col("conversation_id")))
    head, tail = sampling.head_slice(hot, 250), sampling.tail_slice(hot, 250)
    assert head.count() + tail.count() == 300 and head.filter("conversation_id = '5'").count() == 100
    nothing = table(spark, 5).filter("v < 0")
    assert sampling.head_slice(nothing, 9).count() == 0


def test_sample_does_not_shuffle_the_table(spark):
    plan = sampling.seeded_sample(table(spark, 100).select("*"), 10)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Window" not in plan


def test_rows_without_key_stay_in_the_tail_and_are_not_drawn(spark):
    df = spark.createDataFrame([(str(i) if i % 2 else None,) for i in range(10)], "conversation_id string")
    assert sampling.tail_slice(df, 0).count() == 10 and sampling.tail_slice(df, 2).count() == 8
    assert sampling.seeded_sample(df, 5, strict=True).count() == 5
    with pytest.raises(ValueError, match="cannot draw 6 rows from 5"):
        sampling.seeded_sample(df, 6, strict=True)


def test_rows_that_would_be_made_again_are_refused(spark):
    import convoeval.operators.backends as B
    from convoeval.operators.inference import infer

    asked = infer(table(spark, 5), {"m": B.rule_reply}, "m", "conversation_id")
    with pytest.raises(ValueError, match="store them first"):
        sampling.seeded_sample(asked, 2)
