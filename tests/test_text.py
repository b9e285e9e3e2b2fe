from table_values import column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convoeval.functions.columns import with_computed
from convoeval.functions.draws import draw
from convoeval.functions.text import WHITESPACE, normalise_label, reading_ease, strip, word_count
from models import draw as model_draw

QUICK = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
PIECES = st.sampled_from(["a", "b.", " ", "\t", "\n", " ", " ", "　", "​", "\x1c", "\x85", "é", "xyz!"])
TEXTS = st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=60)


def texts_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_whitespace_is_what_python_calls_whitespace():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_word_count_edges(spark):
    texts = ["", "  a\t\nb ", "a b", "a​b", "a\x1cb", None]
    assert column(texts_df(spark, texts).withColumn("n", word_count(F.col("t"))), "n") == [0, 2, 2, 1, 2, None]


@QUICK
@given(TEXTS)
def test_word_count_and_strip_equal_python(spark, texts):
    df = texts_df(spark, texts).select("k", word_count(F.col("t")).alias("n"), strip(F.col("t")).alias("s"))
    assert column(df, "n") == [len(t.split()) for t in texts]
    assert column(df, "s") == [t.strip() for t in texts]


def test_normalised_labels(spark):
    df = texts_df(spark, ["True", " FALSE ", None])
    assert column(df.withColumn("l", normalise_label(F.col("t"))), "l") == ["true", "false", None]
    flags = spark.createDataFrame([(0, True), (1, False)], "k int, b boolean")
    assert column(flags.withColumn("l", normalise_label(F.col("b"))), "l") == ["true", "false"]


def test_reading_ease(spark):
    # "The cat sat." 3 words, 1 sentence, 3 syllables; "brr" has no vowel and counts as one.
    df = texts_df(spark, ["The cat sat.", "brr", "", None, "Queue! Area?"])
    expected = [
        206.835 - 1.015 * 3 - 84.6,
        206.835 - 1.015 - 84.6,
        None,
        None,
        206.835 - 1.015 * 2 / 2 - 84.6 * 3 / 2,
    ]
    got = column(df.withColumn("r", reading_ease(F.col("t"))), "r")
    assert got == [None if e is None else round(e, 6) for e in expected]


def test_draw_equals_model_and_ignores_partitions(spark):
    df = spark.range(200).select(F.col("id").alias("k"), draw(7, F.col("id")).alias("h"))
    expected = [model_draw(7, i) for i in range(200)]
    assert column(df, "h") == expected
    assert column(df.repartition(17), "h") == expected


def test_a_computed_column_is_computed_once(spark):
    df = with_computed(texts_df(spark, ["a b", None, "c"]), "n", word_count(F.col("t")))
    kept = df.filter("n >= 2 or k = 1").filter("n is null or k = 0")
    assert column(kept, "n") == [2, None]

    def mentions(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")

    assert mentions(kept) == mentions(df) > 0
    plain = texts_df(spark, ["a b"]).withColumn("n", word_count(F.col("t"))).filter("n >= 2")
    assert mentions(plain) > mentions(df)
