from convoeval import schemas
from convoeval.operators import backends as B
from convoeval.operators.inference import without_waits
from convoeval.plans import jobs
from convoeval.streaming.arrivals import answer_arrivals
from test_inference import lines, logged


def test_every_file_is_answered_once_and_like_a_batch(spark, tmp_path):
    source, target, log = (str(tmp_path / name) for name in ("in", "out", "log"))

    def ask(df, backend=None):
        return jobs.generate_replies(jobs.augmented_contexts(df), backend or logged(log), without_waits())

    def arrive(first, last):
        rows = [(str(i), "A", f"Customer: q{i}\nAgent: a\nCustomer: r") for i in range(first, last)]
        spark.createDataFrame(rows, schemas.CONVERSATION).coalesce(2).write.mode("append").parquet(source)

    def run():
        answer_arrivals(spark, source, target, str(tmp_path / "progress"), ask, files_per_batch=1).awaitTermination()
        return sorted((r["conversation_id"], r["output_transcript"]) for r in spark.read.parquet(target).collect())

    arrive(0, 10)
    assert len(run()) == 10 and lines(log, "call") == 10
    arrive(10, 15)
    got = run()
    assert lines(log, "call") == 15
    batch = ask(spark.read.schema(schemas.CONVERSATION).parquet(source), B.rule_reply)
    assert got == sorted((r["conversation_id"], r["output_transcript"]) for r in batch.collect())
