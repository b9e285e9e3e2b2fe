from convoeval.llm.shared import labelled_sample, work_folder


def test_work_folders_carry_their_scheme(spark):
    assert work_folder(spark, "x").startswith("file:///")


def test_labelled_sample_fetches_at_most_its_bound(spark):
    rows = [(7, "same key " + "w" * (i % 5)) for i in range(3000)] + [(8, "other text"), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", rows=10, most_bytes=10_000)
    assert 1 <= len(got) <= 10
    assert all(isinstance(t, bytes) for t, _ in got)
    assert {y for _, y in got} <= {0, 1}
