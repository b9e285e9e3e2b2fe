from convoeval.operators import backends as B
from convoeval.operators.inference import without_waits
from convoeval.operators.prompts import programs_table
from convoeval.plans import jobs


def test_document_judges_read_the_whole_text(spark):
    texts = {1: "one two three\nfour five\nsix", 2: "one\ntwo", 3: "one two three four five six", 4: "a b c d e f\n\n"}
    rows = spark.createDataFrame([(k, t, "True") for k, t in texts.items()], "doc_id long, transcript string, gold_standard string")
    program = {"program_id": "p", "task": "judge", "instruction": "Answer True if the text has at least 6 words.", "output_field": "satisfied"}
    judged = jobs.score_judges(rows, programs_table(spark, [program]), B.rule_document_verdict, options=without_waits())
    assert {r["doc_id"]: r["metric"] for r in judged.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
