import pytest
from table_values import column
from pyspark.sql import functions as F

from convoeval.operators import prepare
from convoeval.operators.language import language_tag


def test_blank_company_is_dropped_and_null_kept(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, " "), (3, "A")], "k int, company string")
    assert column(prepare.drop_blank_company(df), "k") == [1, 2, 3]
    assert prepare.drop_blank_company(df.drop("company")).count() == 4


def test_unneeded_columns(spark):
    df = spark.createDataFrame(
        [(None, "m", None), ("", "m", "r")], "llm_response string, llm_metadata string, other string"
    )
    assert prepare.drop_unneeded_columns(df).columns == ["other"]
    full = df.withColumn("llm_response", F.lit("text"))
    assert prepare.drop_unneeded_columns(full).columns == ["llm_response", "other"]
    assert prepare.drop_unneeded_columns(full.filter("false")).columns == ["other"]


def test_text_column_resolution(spark):
    df = spark.createDataFrame([("a b", "c")], "Text string, conversation string")
    assert prepare.text_column(df) == "conversation"
    assert prepare.add_word_count(df).first()["conversation_word_count"] == 1
    assert prepare.add_word_count(df.drop("conversation")).first()["conversation_word_count"] == 2
    neither = df.select(F.lit(1).alias("x"))
    assert prepare.preprocess(neither).columns == ["x"]


def test_language(spark):
    texts = ["The cat and the dog", "Der Hund und die Katze", "le chat et les chiens", "el gato y los perros", "xx yy", "", None, "THE. und"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("l", language_tag(F.col("t")))
    assert column(df, "l") == ["en", "de", "fr", "es", "unknown", "unknown", "unknown", "en"]


def test_rename_and_key(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "conversation_id long, satisfied string")
    assert prepare.rename_columns(df, {"satisfied": "prediction"}).columns == ["conversation_id", "prediction"]
    with pytest.raises(ValueError):
        prepare.rename_columns(df, {"absent": "x"})
    assert sorted((r[0] is None, r[0]) for r in prepare.key_as_string(df).collect())[0] == (False, "1")


def test_labelled_examples(spark):
    df = spark.createDataFrame([("7", "  text\n", 3, None)], "conversation_id string, t string, n int, s string")
    row = prepare.labelled_examples(df, {"transcript": "t", "n": "n", "satisfied": "s"}).first()
    assert row.asDict() == {"_id": "example_7", "transcript": "text", "n": 3, "satisfied": None}


def test_an_empty_struct_column_is_pruned(spark):
    from convoeval.operators.prepare import drop_unneeded_columns

    df = spark.createDataFrame([(1, None), (2, None)], "k int, llm_response struct<a: string>")
    assert drop_unneeded_columns(df).columns == ["k"]
    full = spark.createDataFrame([(1, None), (2, ("x",))], "k int, llm_response struct<a: string>")
    assert drop_unneeded_columns(full).columns == ["k", "llm_response"]
