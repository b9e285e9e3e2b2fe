"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval import schemas
from convoeval.functions.text import normalise_label, reading_ease, word_count
from convoeval.operators import answer_log
from convoeval.operators import backends as B
from convoeval.operators import candidates, comparison, metrics, prepare, prompts, responses, sampling, turns
from convoeval.operators.inference import checkpoint_dir, infer, infer_to_table, without_waits
from convoeval.operators.language import language_tag
from convoeval.plans import jobs
from convoeval.sources import tables
from convoeval.sources.turn_table import conversations_from_turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = "conversation_id"
SEED = 101
# Verdict rules that stand in for judges: satisfied from this many words on.
GOLD_WORDS = 100
BASELINE_WORDS, OPTIMIZED_WORDS = 12, 60
CANDIDATE_WORDS = (20, 60, 120, 250)
FAST = without_waits()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(_table(spark, sf_dir, "documents"))


def _conversations(spark: SparkSession, sf_dir: str, line_break: str = " ") -> DataFrame:
    return conversations_from_turns(_table(spark, sf_dir, "conversations"), line_break)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.augmented_contexts(_conversations(spark, sf_dir), SEED, min_turns=1)


def _examples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Labelled documents as judge examples: transcript, gold verdict and more columns."""
    docs, labels = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    gold = labels.select("doc_id", F.when(F.col("quality") == 1, "True").otherwise("False").alias("gold_standard"))
    return docs.select("doc_id", F.col("text").alias("transcript"), *columns).join(gold, "doc_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of a word-count rule next to the gold verdict, per labelled document."""
    docs, labels = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    said = F.when(word_count(F.col("text")) >= GOLD_WORDS, " True").otherwise("FALSE")
    predictions = docs.select("doc_id", normalise_label(said).alias("satisfied"))
    gold = labels.select("doc_id", normalise_label(F.col("quality") == 1).alias("satisfied"))
    return metrics.prediction_with_gold(predictions, gold, "doc_id")


def _judge_programs(spark: SparkSession) -> DataFrame:
    return prompts.programs_table(
        spark,
        [
            {
                "program_id": f"judge_{n}",
                "task": "judge",
                "instruction": f"Answer True if the last line has at least {n} words.",
                "output_field": "satisfied",
                "output_desc": "True or False",
                "demos": [("Customer: hi", "False")] if n == CANDIDATE_WORDS[0] else [],
                "model_name": "rule",
            }
            for n in CANDIDATE_WORDS
        ],
    )


def _document_programs(spark: SparkSession) -> DataFrame:
    """The judges of ``_judge_programs`` for documents: the words of the whole text count."""
    return _judge_programs(spark).withColumn(
        "instruction", F.regexp_replace("instruction", "the last line has", "the text has")
    )


def _reply_programs(spark: SparkSession) -> DataFrame:
    return prompts.programs_table(
        spark,
        [
            {
                "program_id": "reply",
                "task": "reply",
                "instruction": prompts.REPLY_INSTRUCTION,
                "output_field": "llm_response",
                "output_desc": "the next support message",
                "temperature": 1.0,
            }
        ],
    )


def _last_line(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def _word_rule(text: Column, least: int) -> Column:
    return (word_count(_last_line(text)) >= least).cast("string")


# --- tables -----------------------------------------------------------------------------


@query
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(name: str) -> DataFrame:
        return _table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    return counted("conversations").union(counted("documents")).union(counted("labels"))


@query
def row_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preview_row(_table(spark, sf_dir, "documents"), "doc_id", 4).select("doc_id", "lang", "text")


@query
def ingest_seed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("Session Name"), F.col("text").alias("Text"), "role"
    )
    return tables.ingest_seed_messages(raw)


@query
def turns_with_other_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which assistants are agents or tools; tools have no printed name of their own."""
    role = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 4 < 2, "agent").otherwise("tool"))
    turns = _table(spark, sf_dir, "conversations").withColumn("role", F.coalesce(role, "role"))
    return conversations_from_turns(turns, speakers={"user": "Customer", "agent": "Support"})


@query
def seed_message_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(ingest_seed_messages(spark, sf_dir), 50, seed=0)


# --- preparation ------------------------------------------------------------------------


@query
def render_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir)


@query
def preprocess_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _conversations(spark, sf_dir).withColumns(
        {"llm_metadata": F.lit("{}"), "llm_response": F.lit(None).cast("string")}
    )
    return prepare.preprocess(raw)


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.add_word_count(
        _documents(spark, sf_dir).select("doc_id", F.col("text").alias("Text"))
    ).select("doc_id", "conversation_word_count")


@query
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", language_tag(F.col("text")).alias("language"))


@query
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _documents(spark, sf_dir).select(
        F.col("lang").alias("gold_standard"), language_tag(F.col("text")).alias("prediction")
    )
    return metrics.confusion_matrix(tagged)


@query
def labelled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.labelled_examples(
        _examples(spark, sf_dir).withColumn("n", F.length("transcript")),
        {"transcript": "transcript", "satisfied": "gold_standard", "n_chars": "n"},
        key="doc_id",
    )


# --- turns ------------------------------------------------------------------------------


@query
def parse_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.explode_turns(_conversations(spark, sf_dir))


@query
def parse_unlabelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages keep their newlines here, so that many lines carry no speaker."""
    return turns.explode_turns(_conversations(spark, sf_dir, "\n"))


@query
def truncate_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.truncate_table(_conversations(spark, sf_dir), SEED, min_turns=1).select(
        KEY, "truncated_conversation"
    )


@query
def truncate_with_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.truncate_table(_conversations(spark, sf_dir, "\n"), min_turns=2, max_turns=6).select(
        KEY, "truncated_conversation"
    )


@query
def truncation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.truncation_statistics(turns.truncate_table(_conversations(spark, sf_dir), SEED, min_turns=1))


@query
def truncation_is_reproducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of conversations that a second run over other partitions cuts elsewhere."""
    source = _conversations(spark, sf_dir)
    first = turns.truncate_table(source, SEED, min_turns=1).withColumnRenamed("truncated_conversation", "first")
    second = turns.truncate_table(source.repartition(17), SEED, min_turns=1)
    both = turns.pair_original_with_truncated(first, second, original_field="first")
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("first").eqNullSafe(F.col("truncated_conversation"))).alias("mismatches"),
    )


@query
def split_company_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesised texts made from the conversations: two paragraphs, one, or no colon."""
    text = (
        F.when(F.col("company").isNull(), F.concat(F.lit("Conversation "), F.translate("conversation", ":", " ")))
        .when(F.col("company") == "", F.concat(F.lit("Company: \nConversation:\n"), F.col("conversation")))
        .otherwise(
            F.concat(
                F.lit("Company: "),
                F.col("company"),
                F.lit("\n\nConversation:\n"),
                F.regexp_replace("conversation", "\n", "\n\n"),
            )
        )
    )
    source = _conversations(spark, sf_dir).select(KEY, text.alias("llm_response"))
    return responses.split_company_and_conversation(source).select(KEY, "company", "conversation")


# --- prompts ----------------------------------------------------------------------------


@query
def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select(KEY, "company_and_transcript")


@query
def output_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text replies and struct replies; where the last turn is the agent's there is no reply."""
    ctx = _contexts(spark, sf_dir)
    reply = F.when(
        ~F.startswith(_last_line(F.col("truncated_conversation")), F.lit("Agent:")),
        F.concat(F.lit("Thank you, "), F.coalesce("company", F.lit("we"))),
    )
    struct = F.when(reply.isNotNull(), F.struct(F.lit("rule").alias("reasoning"), reply.alias("llm_response")))
    context = F.col("company_and_transcript")
    return ctx.select(
        KEY,
        prompts.output_transcript(context, reply).alias("from_text"),
        prompts.output_transcript(context, struct["llm_response"]).alias("from_struct"),
    )


@query
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = prompts.chat_messages(F.lit(prompts.REPLY_INSTRUCTION), F.col("company_and_transcript"))
    return _contexts(spark, sf_dir).select(KEY, F.posexplode(messages).alias("position", "m")).select(
        KEY, "position", "m.role", "m.content"
    )


@query
def flat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("company_and_transcript")
    asked = _contexts(spark, sf_dir).select(
        KEY, text, F.explode(F.array(*map(F.lit, B.PROVIDERS))).alias("provider")
    )
    request = prompts.provider_request(F.col("provider"), F.lit(prompts.REPLY_INSTRUCTION), text)
    return asked.withColumn("request", request).select(
        KEY,
        "provider",
        F.col("request.system").alias("system"),
        F.coalesce(F.size("request.messages"), F.lit(0)).alias("n_messages"),
        F.col("request.messages")[0]["content"].alias("first_message"),
        F.col("request.prompt").alias("prompt"),
    )


@query
def program_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = prompts.latest_programs(_judge_programs(spark))
    return prompts.with_program_prompts(
        _contexts(spark, sf_dir).select(KEY, "company_and_transcript"), latest, "judge", "company_and_transcript"
    ).select(KEY, "program_id", "system_prompt", "user_prompt")


# --- responses --------------------------------------------------------------------------


def _provider_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata text of every provider, and none, with numbers taken from the turns."""
    given = F.length("text").cast("string")
    made = F.col("turn").cast("string")
    kinds = {
        "openai": F.concat(
            F.lit('{"id":"c'), F.col("conv_id").cast("string"),
            F.lit('","model":"m","created":7,"object":"chat","usage":{"prompt_tokens":'), given,
            F.lit(',"completion_tokens":'), made, F.lit(',"total_tokens":'),
            (F.length("text") + F.col("turn")).cast("string"), F.lit('},"choices":[{"finish_reason":"stop"}]}'),
        ),
        "anthropic": F.concat(
            F.lit('{"id":"c'), F.col("conv_id").cast("string"), F.lit('","usage":{"input_tokens":'), given,
            F.lit(',"output_tokens":'), made, F.lit('},"stop_reason":"end_turn"}'),
        ),
        "gemini": F.concat(
            F.lit('{"usage_metadata":{"prompt_token_count":'), given,
            F.lit(',"candidates_token_count":'), made, F.lit("}}"),
        ),
        "no_usage": F.lit('{"raw":"text only"}'),
        "broken": F.lit("not json"),
        "none": F.lit(None).cast("string"),
    }
    each = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("metadata_raw")) for k, v in kinds.items()))
    return (
        _table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", F.inline(each))
        .withColumn("meta", responses.parse_metadata(F.col("metadata_raw")))
    )


@query
def normalised_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _provider_metadata(spark, sf_dir)
        .withColumn("usage", responses.usage_of(F.col("meta")))
        .select("conv_id", "turn", "kind", "usage.input_tokens", "usage.output_tokens")
    )


@query
def normalised_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = responses.normalise_metadata(F.col("metadata_raw"), F.col("meta"))
    return (
        _provider_metadata(spark, sf_dir)
        .withColumn("m", normal)
        .select(
            "conv_id", "turn", "kind", "m.id", "m.model", "m.created", "m.object", "m.finish_reason",
            F.col("m.usage.prompt_tokens").alias("prompt_tokens"),
            F.col("m.usage.completion_tokens").alias("completion_tokens"),
            F.col("m.usage.total_tokens").alias("total_tokens"),
            "m.raw", "m.error",
        )
    )


def _reply_texts(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("reply"))


@query
def structured_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed verdicts from users, ill-typed from assistants, plain text from system."""
    n = F.length("text")
    text = (
        F.when(
            F.col("role") == "user",
            F.concat(
                F.lit('{"satisfied":'), (n >= 100).cast("string"),
                F.lit(',"explanation":"'), n.cast("string"), F.lit(' characters"}'),
            ),
        )
        .when((F.col("role") == "assistant") & (n < 400), F.lit('{"satisfied":"maybe","explanation":"x"}'))
        .when((F.col("role") == "assistant") & (n < 800), F.lit('{"satisfied":true}'))
        .when(F.col("role") == "system", F.lit("oops"))
    )
    checked = responses.add_checked_response(
        _reply_texts(spark, sf_dir, text), "reply", schemas.STRUCTURED_VERDICT
    )
    return responses.extract_structured_verdict(checked).select(
        "conv_id", "turn", "valid", "satisfied", "explanation"
    )


@query
def program_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(
        F.col("role") != "system",
        F.concat(
            F.lit('{"reasoning":"'), F.col("role"),
            F.lit('","satisfied":"'), F.when(F.length("text") >= 100, "True").otherwise(" FALSE "), F.lit('"}'),
        ),
    )
    checked = responses.add_checked_response(_reply_texts(spark, sf_dir, text), "reply", schemas.PROGRAM_VERDICT)
    return responses.extract_program_verdict(checked).select("conv_id", "turn", "satisfied", "explanation")


# --- inference --------------------------------------------------------------------------


def _fails_on_short(request: B.Request) -> bool:
    return len(request["user"].split()) < 40


def _failures_by_words(request: B.Request) -> int:
    return len(request["user"].split()) % 4


@query
def infer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to all contexts. Calls on short contexts fail every time."""
    backend = B.failing(B.rule_reply, _fails_on_short)
    replies = jobs.generate_replies(_contexts(spark, sf_dir), backend, FAST)
    return replies.select(KEY, "llm_response", "input_tokens", "output_tokens", "error")


@query
def infer_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = B.failing(B.rule_verdict, _fails_on_short)
    judged = jobs.judge_structured(
        _contexts(spark, sf_dir), backend, "company_and_transcript", instruction="at least 30 words", options=FAST
    )
    return judged.select(KEY, "satisfied", "explanation", "input_tokens", "output_tokens", "error")


@query
def infer_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = jobs.judge_with_programs(
        _contexts(spark, sf_dir), _judge_programs(spark), B.rule_program_verdict, "company_and_transcript", FAST
    )
    return judged.select(KEY, "program_id", "satisfied", "explanation", "input_tokens", "output_tokens")


@query
def infer_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 3 failing attempts by the number of words; three attempts are made."""
    backend = B.flaky(B.rule_reply, _failures_by_words)
    asked = infer(
        _contexts(spark, sf_dir), {"model": backend}, "model", "company_and_transcript", options=FAST
    )
    return asked.select(
        KEY,
        F.col("call.attempts").alias("attempts"),
        F.col("call.error").alias("error"),
        F.col("call.response_text").alias("llm_response"),
    )


def _answers_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"


@query
def resume_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run in which short contexts fail, and a second run over what is left."""
    ctx = _contexts(spark, sf_dir).select(KEY, "company_and_transcript")
    ask = {"provider": "model", "input_field": "company_and_transcript", "keys": [KEY], "options": FAST}
    path = _answers_folder(spark)
    infer_to_table(ctx, path, {"model": B.failing(B.rule_reply, _fails_on_short)}, **ask)
    return infer_to_table(ctx, path, {"model": B.rule_reply}, **ask).select(
        KEY, F.col("call.response_text").alias("llm_response"), F.col("call.error").alias("error")
    )


@query
def stored_inference_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over different rows: short contexts fail in the first and stay failed if not asked again.

    Conversations whose number is divisible by 3 are in the first run only, those with remainder
    1 in the second only. The key is null for numbers divisible by 10. In the second run numbers
    divisible by 4 have another system prompt, which makes another request of the same key.
    """
    number = F.col(KEY).cast("int")
    ctx = _contexts(spark, sf_dir).select(KEY, "company_and_transcript")
    ctx = ctx.withColumn("key", F.when(number % 10 != 0, F.col(KEY)))
    ask = {"provider": "model", "input_field": "company_and_transcript", "keys": ["key"], "options": FAST}
    path = _answers_folder(spark)
    infer_to_table(
        ctx.filter(number % 3 != 1), path, {"model": B.failing(B.rule_reply, _fails_on_short)}, system_prompt="first", **ask
    )
    changed = F.when(number % 4 == 0, F.lit("second")).otherwise(F.lit("first"))
    done = infer_to_table(
        ctx.filter(number % 3 != 0), path, {"model": B.rule_reply}, system_prompt=changed, waves=2, **ask
    )
    return done.select(
        "key", KEY, F.col("call.response_text").alias("llm_response"), F.col("call.error").alias("error")
    )


@query
def stored_inference_empty_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over no row, then one over all."""
    ctx = _contexts(spark, sf_dir).select(KEY, "company_and_transcript")
    ask = {"provider": "model", "input_field": "company_and_transcript", "keys": [KEY], "options": FAST}
    path = _answers_folder(spark)
    infer_to_table(ctx.filter(F.lit(False)), path, {"model": B.rule_reply}, **ask)
    return infer_to_table(ctx, path, {"model": B.rule_reply}, **ask).select(
        KEY, F.col("call.response_text").alias("llm_response"), F.col("call.error").alias("error")
    )


@query
def misfits_tried_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured verdicts whose first 0 to 3 answers, by the number of words, do not fit."""
    judged = jobs.judge_structured(
        _contexts(spark, sf_dir),
        B.misfitting(B.rule_verdict, _failures_by_words),
        "company_and_transcript",
        instruction=f"at least {BASELINE_WORDS} words",
        options=FAST,
    )
    return judged.select(KEY, "satisfied", "attempts", "error")


@query
def synthesis_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jobs.synthesise_conversations(ingest_seed_messages(spark, sf_dir), B.rule_synthesis, FAST)
    return made.select(KEY, "company", "conversation", "input_tokens", "output_tokens")


@query
def generation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.generate_replies(_contexts(spark, sf_dir), B.rule_reply, FAST).select(KEY, "output_transcript")


@query
def program_generation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = jobs.run_programs(
        _contexts(spark, sf_dir), _reply_programs(spark), "reply", B.rule_program_reply,
        schemas.PROGRAM_REPLY, "company_and_transcript", FAST,
    )
    text = prompts.output_transcript(F.col("company_and_transcript"), F.col("response.llm_response"))
    return replies.select(KEY, text.alias("output_transcript"))


@query
def judge_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = jobs.generate_replies(_contexts(spark, sf_dir), B.rule_reply, FAST)
    judged = jobs.judge_structured(
        replies, B.rule_verdict, instruction="at least 12 words", options=FAST
    )
    return judged.select(KEY, "satisfied", "explanation")


def _killed_on(inner: B.Backend, dies) -> B.Backend:
    """``inner``, whose task dies (no retry catches it) on the requests for which ``dies`` holds."""

    class Lost(BaseException):
        pass

    def factory() -> B.Client:
        client = inner()

        def call(request: B.Request) -> dict:
            if dies(request):
                raise Lost("the task was lost")
            return client(request)

        return call

    return factory


def _long_input(request: B.Request) -> bool:
    return len(request["user"]) % 7 == 0


@query
def resumed_judge_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored judge job in four waves whose tasks die on some requests, run again to the end.

    The waves that committed before the failure are not asked again; the result is that of one
    clean run.
    """
    replies = jobs.generate_replies(_contexts(spark, sf_dir), B.rule_reply, FAST)
    path, judge = _answers_folder(spark), {"instruction": "at least 12 words", "options": FAST, "waves": 4}
    try:
        jobs.judge_structured(replies, _killed_on(B.rule_verdict, _long_input), path=path, **judge).count()
    except Exception:  # the job failed as a lost executor would make it fail
        pass
    judged = jobs.judge_structured(replies, B.rule_verdict, path=path, **judge)
    return judged.select(KEY, "satisfied", "explanation")


@query
def current_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies stored under one system prompt, then asked with a new one for every third key.

    The log keeps both answers of those keys; the view returns the one of the current request.
    """
    ctx = _contexts(spark, sf_dir).select(KEY, "company_and_transcript")
    ask = {"provider": "model", "input_field": "company_and_transcript", "keys": [KEY], "options": FAST}
    path = _answers_folder(spark)
    answer_log.ask(ctx, path, {"model": B.rule_reply}, system_prompt="first", **ask)
    changed = F.when(F.col(KEY).cast("int") % 3 == 0, F.lit("second")).otherwise(F.lit("first"))
    done = answer_log.ask(ctx, path, {"model": B.rule_reply}, system_prompt=changed, **ask)
    return done.select(KEY, F.col("call.response_text").alias("llm_response"), F.col("call.error").alias("error"))


# --- metrics ----------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = B.failing(B.rule_reply, _fails_on_short)
    return jobs.generate_replies(_contexts(spark, sf_dir), backend, FAST)


@query
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_statistics(_answers(spark, sf_dir))


@query
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.success_rate(_answers(spark, sf_dir))


@query
def call_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = infer(
        _contexts(spark, sf_dir), {"model": B.rule_reply}, "model", "company_and_transcript", options=FAST
    )
    timed = metrics.throughput(asked)
    return timed.select("calls", (F.col("seconds") > 0).alias("took_time"), (F.col("calls_per_second") > 0).alias("has_rate"))


@query
def provider_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = B.failing(B.rule_reply, lambda r: r["provider"] == "gemini" and _fails_on_short(r))
    return comparison.compare_providers(
        _contexts(spark, sf_dir), {name: backend for name in B.PROVIDERS}, "company_and_transcript",
        prompts.REPLY_INSTRUCTION, FAST,
    )


@query
def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of conversations; those that end with the agent are not judged."""
    text = F.col("conversation")
    judged = _conversations(spark, sf_dir).select(
        F.when(
            ~F.startswith(_last_line(text), F.lit("Agent:")), _word_rule(text, BASELINE_WORDS)
        ).alias("satisfied")
    )
    return metrics.verdict_distribution(judged)


@query
def verdict_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement_rate(_pairs(spark, sf_dir))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_pairs(spark, sf_dir))


@query
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cohen_kappa(_pairs(spark, sf_dir))


@query
def judge_agreement_on_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a cheap rule agrees with a strict one on truncated conversations, and kappa."""
    ctx = _contexts(spark, sf_dir)
    text = F.col("company_and_transcript")
    pairs = ctx.select(
        _word_rule(text, BASELINE_WORDS).alias("prediction"), _word_rule(text, 30).alias("gold_standard")
    )
    return metrics.cohen_kappa(pairs)


@query
def judge_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match per document, and the transcript that a judge metric would read."""
    predicted = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.concat(F.lit("shown: "), "transcript"))
    shown = metrics.judged_transcript(predicted, F.col("transcript"))
    rows = _examples(spark, sf_dir).withColumn("n", word_count(F.col("transcript")))
    said = F.when(F.col("n") >= GOLD_WORDS, "True").when(F.col("n") >= 50, " true").otherwise("FALSE")
    return rows.select(
        "doc_id",
        metrics.exact_match(F.col("gold_standard"), said).alias("metric"),
        metrics.judged_true(said).alias("judged_true"),
        shown.alias("judged_transcript"),
    )


@query
def program_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of one judge program over all labelled documents, as a percent."""
    one = _document_programs(spark).filter(F.col("program_id") == f"judge_{CANDIDATE_WORDS[1]}")
    judged = jobs.score_judges(_examples(spark, sf_dir), one, B.rule_document_verdict, options=FAST)
    return candidates.candidate_scores(judged)


@query
def generator_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies judged by a judge program: percent satisfied per generator program."""
    one = _judge_programs(spark).filter(F.col("program_id") == f"judge_{CANDIDATE_WORDS[0]}")
    examples = _contexts(spark, sf_dir).select(KEY, F.col("company_and_transcript").alias("transcript"))
    judged = jobs.score_generators(
        examples, _reply_programs(spark), B.rule_program_reply, one, B.rule_program_verdict, options=FAST
    )
    return candidates.candidate_scores(judged)


@query
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _documents(spark, sf_dir).select(word_count(F.col("text")).alias("n_words"))
    return metrics.histogram(counted, "n_words", low=0, width=50)


@query
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", reading_ease(F.col("text")).alias("reading_ease"))


@query
def readability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(readability(spark, sf_dir), "reading_ease", low=0, width=10)


# --- comparison -------------------------------------------------------------------------


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on contexts against verdicts on whole conversations, by two rules."""
    ctx = _contexts(spark, sf_dir)

    def run(text: Column, least: int) -> DataFrame:
        counted = ctx.select(KEY, text.alias("output_transcript"), word_count(_last_line(text)).alias("n"))
        verdict = F.when(F.col("n") % 10 != 0, (F.col("n") >= least).cast("string"))
        words = F.concat(F.col("n").cast("string"), F.lit(" words"))
        return counted.select(
            KEY, "output_transcript", words.alias("explanation"), verdict.alias("satisfied")
        )

    return comparison.compare_runs(
        run(F.col("company_and_transcript"), BASELINE_WORDS), run(F.col("conversation"), OPTIMIZED_WORDS)
    )


@query
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@query
def switched_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.switched_verdicts(_compared(spark, sf_dir))


@query
def switched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.switched_summary(_compared(spark, sf_dir))


@query
def switched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.switched_report(_compared(spark, sf_dir))


# --- samples, splits, candidates --------------------------------------------------------


@query
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(_table(spark, sf_dir, "documents"), 400, seed=10, key="doc_id").select(
        "doc_id", "lang", "n_chars"
    )


@query
def strict_seed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict sample from a table in which every tenth row has no key."""
    keyed = _table(spark, sf_dir, "documents").withColumn("key", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")))
    return sampling.seeded_sample(keyed, 100, seed=3, key="key", strict=True).select("doc_id", "key", "lang")


@query
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_test_split(_table(spark, sf_dir, "labels"), 0.4, seed=10, key="doc_id")


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_test_split(_table(spark, sf_dir, "labels"), 0.4, seed=10, key="doc_id", exact=False)


@query
def ordered_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    head = sampling.head_slice(labels, 110, "doc_id").withColumn("part", F.lit("training"))
    return head.union(sampling.tail_slice(labels, 110, "doc_id").withColumn("part", F.lit("validation")))


def _judged_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.score_judges(
        _examples(spark, sf_dir), _document_programs(spark), B.rule_document_verdict, options=FAST
    )


@query
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_scores(_judged_examples(spark, sf_dir))


def _versions(spark: SparkSession) -> DataFrame:
    """One program in as many versions as there are word bounds."""
    rows = [
        {
            "program_id": "judge",
            "version": v,
            "task": "judge",
            "instruction": f"Answer True if the text has at least {n} words.",
            "output_field": "satisfied",
        }
        for v, n in enumerate(CANDIDATE_WORDS, 1)
    ]
    return prompts.programs_table(spark, rows)


def _judged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.score_judges(_examples(spark, sf_dir), _versions(spark), B.rule_document_verdict, options=FAST)


@query
def candidate_scores_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_scores(_judged_versions(spark, sf_dir))


@query
def best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.best_candidate(_judged_versions(spark, sf_dir))


@query
def latest_version_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the latest of several versions."""
    rows = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("transcript"))
    out = prompts.with_program_prompts(rows, prompts.latest_programs(_versions(spark)), "judge")
    return out.select("doc_id", "program_id", "version", "user_prompt")


@query
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.best_candidate(_judged_examples(spark, sf_dir))


@query
def demo_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    demos = candidates.select_demos(_judged_examples(spark, sf_dir), k=2, seed=SEED, key="doc_id")
    return demos.select("program_id", "gold_standard", "rank", "doc_id")
