"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.llm import bpe, divergence, jaccard, lexical, lm, packing, quality_cnn, rules, simhash, token_store, topk, toxicity, warc
from convoeval.llm.shared import work_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_network(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality_cnn.classify(documents, _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


@_query
def op2_bpe_round_trip(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(documents, TOKENIZER)
    return done.select("doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256")


@_query
def op3_pivot_top_k(spark, sf_dir):
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, copies=True)


ORACLES["op3_pivot_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op4_toxicity(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.classify(documents, _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


@_query
def op6_jaccard_join(spark, sf_dir):
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op7_quality_rules(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(documents).select("doc_id", *rules.COUNTS, "base_failed", "kept", "posterior")


@_query
def op8_token_shards(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.write_and_read(documents, work_folder(spark, "tokens"), TOKENIZER)


@_query
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


@_query
def op5_warc(spark, sf_dir):
    folder = work_folder(spark, "warc")
    records = warc.read(warc.write(_table(spark, sf_dir, "pages"), folder), folder)
    return records.select(
        F.col("page_id").cast("long"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long"),
    )


@_query
def op10_language_model(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op11_lexical_search(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(documents, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS_11 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS_11} AS t FROM documents),
n AS (SELECT rid, doc_id, len(t)::BIGINT AS n FROM d),
g AS (SELECT count(*) FILTER (WHERE n > 0)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, g),
q AS (SELECT item_id, unnest({_TERMS_11}) AS term FROM benchmark),
m AS (SELECT rid, doc_id, 25 + (75 * n * big_n) // big_l AS m FROM n, g WHERE n > 0),
s AS (
    SELECT q.item_id, m.rid, m.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid)
    GROUP BY q.item_id, m.rid, m.doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@_query
def op12_simhash_near_dedup(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(documents).select("doc_id", "fingerprint", "component_id")


# op12 has no SQL: DuckDB has no XXH64. tests/llm/test_simhash.py holds it against brute force.


@_query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


_TERMS_13 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op13_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS_13} AS t FROM documents),
o AS (SELECT rid, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT l.lang, count(k.term)::BIGINT AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT o.lang, o.source, o.term, count(*)::BIGINT AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(gc.c, 0)::BIGINT AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN gc USING (lang, source, term)),
gn AS (SELECT lang, source, sum(c)::BIGINT AS n FROM cells GROUP BY ALL),
lc AS (SELECT lang, term, sum(c)::BIGINT AS c FROM cells GROUP BY ALL),
ln AS (SELECT lang, sum(c)::BIGINT AS n FROM lc GROUP BY lang),
gp AS (
    SELECT x.lang, x.source, x.term, x.c, (1 + (1000000000::HUGEINT * (x.c + 2)) // (gn.n + 2 * v.v))::BIGINT AS p
    FROM cells x JOIN gn USING (lang, source) JOIN v USING (lang)
),
lp AS (
    SELECT lc.lang, lc.term, (1 + (1000000000::HUGEINT * (lc.c + 2)) // (ln.n + 2 * v.v))::BIGINT AS q
    FROM lc JOIN ln USING (lang) JOIN v USING (lang)
),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
    FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (
    SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, (((gp.p - lp.q) * (gp.p - lp.q)) // (gp.p + lp.q))::BIGINT AS value
    FROM gp JOIN lp USING (lang, term)
    WHERE gp.c > 0 AND gp.p > lp.q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


# The pipeline of these operators; it lies at the top of the repository and is part of them.
import corpus_pipeline  # noqa: E402

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
