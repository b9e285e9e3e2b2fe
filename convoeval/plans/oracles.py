"""The registered queries as plain SQL, written independently of the operators.

The SQL works with windows, unnesting and string functions where the operators use array
expressions or a model call, so that an error in one does not repeat in the other.
"""

from __future__ import annotations

from convoeval.operators.language import PROFILES, UNKNOWN
from convoeval.operators.prompts import REPLY_INSTRUCTION, SYNTHESIS_INSTRUCTION
from convoeval.plans.queries import (
    BASELINE_WORDS,
    CANDIDATE_WORDS,
    GOLD_WORDS,
    OPTIMIZED_WORDS,
    SEED,
)

NL = "chr(10)"


def _words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def _n_words(text: str) -> int:
    return len(text.split())


def _draw(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{seed}', ':', {key})), 1, 8) AS BIGINT)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _last_line(x: str) -> str:
    return f"list_extract(string_split({x}, {NL}), -1)"


def _convs(line_break: str = " ") -> str:
    put = NL if line_break == "\n" else f"'{line_break}'"
    return f"""
said AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn,
         CASE role WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'Agent' END
           || ': ' || regexp_replace(text, '\\r\\n|\\r|\\n', {put}, 'g') AS line,
         CASE WHEN role = 'system' THEN regexp_extract(text, '^[A-Za-z]+') END AS company
  FROM conversations),
convs AS (
  SELECT conversation_id, max(company) AS company, string_agg(line, {NL} ORDER BY turn, line) AS conversation
  FROM said GROUP BY conversation_id HAVING count(line) > 0)"""


# Turns of convs: the role of an unlabelled line follows from its distance to the last label.
_TURNS = f"""
numbered AS (
  SELECT conversation_id, unnest(string_split(conversation, {NL})) AS raw,
         generate_subscripts(string_split(conversation, {NL}), 1) AS pos
  FROM convs),
lines AS (
  SELECT conversation_id, {_strip('raw')} AS line,
         row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS i
  FROM numbered WHERE {_strip('raw')} <> ''),
labelled AS (
  SELECT *, CASE WHEN starts_with(line, 'Customer:') OR starts_with(line, 'User:') THEN 0
                 WHEN starts_with(line, 'Agent:') OR starts_with(line, 'Support:') THEN 1 END AS label
  FROM lines),
placed AS (
  SELECT *, last_value(CASE WHEN label IS NOT NULL THEN i END IGNORE NULLS) OVER w AS last_i,
         last_value(label IGNORE NULLS) OVER w AS last_label
  FROM labelled
  WINDOW w AS (PARTITION BY conversation_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
turns AS (
  SELECT conversation_id, CAST(i AS INTEGER) AS i,
         CASE WHEN (coalesce(last_label, 0) + i - coalesce(last_i, 0)) % 2 = 0
              THEN 'customer' ELSE 'agent' END AS role,
         CASE WHEN label IS NULL THEN line ELSE {_strip("substr(line, strpos(line, ':') + 1)")} END AS content
  FROM placed)"""


def _truncated(seed: int, min_turns: int, max_turns: int | None = None) -> str:
    hi = f"least(n, {max_turns})" if max_turns else "n"
    return f"""
sizes AS (SELECT conversation_id, count(*) AS n FROM turns GROUP BY 1),
cuts AS (
  SELECT convs.*, coalesce(n, 0) AS n,
         {min_turns} + {_draw(seed, 'conversation_id')} % greatest({hi} - {min_turns} + 1, 1) AS k
  FROM convs LEFT JOIN sizes USING (conversation_id)),
customers AS (
  SELECT conversation_id, max(i) + 1 AS last_customer
  FROM turns JOIN cuts USING (conversation_id) WHERE role = 'customer' AND i < k GROUP BY 1),
kept AS (
  SELECT conversation_id,
         string_agg(CASE role WHEN 'customer' THEN 'Customer: ' ELSE 'Agent: ' END || content,
                    {NL} ORDER BY i) AS text
  FROM turns JOIN cuts USING (conversation_id) LEFT JOIN customers USING (conversation_id)
  WHERE i < coalesce(last_customer, k) GROUP BY 1),
truncated AS (
  SELECT conversation_id, company, conversation,
         CASE WHEN n <= {min_turns} THEN conversation ELSE text END AS truncated_conversation
  FROM cuts LEFT JOIN kept USING (conversation_id))"""


_CTX = f"""{_convs()}, {_TURNS}, {_truncated(SEED, 1)},
ctx AS (
  SELECT *, 'Company: ' || coalesce(company, 'None') || {NL} || 'Transcript so far: '
            || truncated_conversation AS company_and_transcript
  FROM truncated)"""

_IN_WORDS = _words("company_and_transcript")

def _reply(n: str) -> str:
    return (
        f"'Thank you. We read your ' || ({n}) || ' words and will help.' || "
        f"CASE WHEN {n} >= 100 THEN ' As this is a long story, we answer every point of it in turn.' ELSE '' END"
    )


_REPLY = _reply(_IN_WORDS)
# A program prompt has one word more, the name of its input field.
_PROGRAM_REPLY = _reply(f"{_IN_WORDS} + 1")
_REPLY_WORDS = _words(_REPLY)
_FAILS = f"{_IN_WORDS} < 40"
_BUSY = "'ConnectionError: busy'"

# A first text call over ctx, in which short contexts fail.
_ANSWERS = f"""{_CTX},
answers AS (
  SELECT conversation_id,
         CASE WHEN {_FAILS} THEN NULL ELSE {_REPLY} END AS llm_response,
         CASE WHEN {_FAILS} THEN 0 ELSE {_IN_WORDS} + {_n_words(REPLY_INSTRUCTION)} END AS input_tokens,
         CASE WHEN {_FAILS} THEN 0 ELSE {_REPLY_WORDS} END AS output_tokens,
         CASE WHEN {_FAILS} THEN {_BUSY} END AS error
  FROM ctx)"""

_STATISTICS = """
  count(*) AS total_examples,
  count(*) FILTER (input_tokens > 0) AS successful_calls,
  count(*) FILTER (input_tokens = 0) AS failed_calls,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
  coalesce(round(avg(input_tokens) FILTER (input_tokens > 0), 6), 0) AS avg_input_tokens,
  coalesce(round(avg(output_tokens) FILTER (output_tokens > 0), 6), 0) AS avg_output_tokens"""


def _last_words(x: str) -> str:
    return _words(_last_line(f"regexp_replace({x}, '\\s+$', '')"))


_EXAMPLES = """
examples AS (
  SELECT doc_id, text AS transcript, CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS gold_standard
  FROM documents JOIN labels USING (doc_id))"""

_PAIRS = f"""
pairs AS (
  SELECT doc_id, CASE WHEN {_words('text')} >= {GOLD_WORDS} THEN 'true' ELSE 'false' END AS prediction,
         CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS gold_standard
  FROM documents JOIN labels USING (doc_id))"""

_KAPPA = """
margins AS (
  SELECT (SELECT count(*) FROM pairs) AS total,
         (SELECT count(*) FROM pairs WHERE prediction = gold_standard) AS same,
         (SELECT sum(CAST(p.n AS DOUBLE) * g.n)
          FROM (SELECT prediction AS l, count(*) AS n FROM pairs GROUP BY 1) p
          JOIN (SELECT gold_standard AS l, count(*) AS n FROM pairs GROUP BY 1) g USING (l)) AS by_chance),
shares AS (
  SELECT total, same / total AS o, by_chance / total / total AS e FROM margins)
SELECT total, round(o, 6) AS observed, round(e, 6) AS expected,
       CASE WHEN e < 1 THEN round((o - e) / (1 - e), 6) END AS kappa
FROM shares"""

_PROGRAMS = "programs AS (SELECT unnest([" + ", ".join(map(str, CANDIDATE_WORDS)) + "]) AS least)"

# One row per (program, example): the words of the whole document decide.
_JUDGED = f"""{_EXAMPLES}, {_PROGRAMS},
judged AS (
  SELECT 'judge_' || least AS program_id, least, doc_id, gold_standard,
         CASE WHEN {_words("transcript")} >= least THEN 'true' ELSE 'false' END AS satisfied
  FROM examples CROSS JOIN programs),
scored AS (SELECT *, CASE WHEN lower(gold_standard) = satisfied THEN 1 ELSE 0 END AS metric FROM judged)"""

_SCORES = "SELECT program_id, CAST(1 AS INTEGER) AS version, count(*) AS examples, round(100 * avg(metric), 6) AS score FROM scored"

_VERSIONS = f"""
versions AS (
  SELECT 'judge' AS program_id, CAST(list_position({list(CANDIDATE_WORDS)}, least) AS INTEGER) AS version,
         count(*) AS examples, round(100 * avg(metric), 6) AS score
  FROM scored GROUP BY least)"""


def _tagged(columns: str) -> str:
    hits = ", ".join(
        f"(SELECT count(*) FROM (SELECT unnest(words) AS w) WHERE w IN ({', '.join(repr(x) for x in PROFILES[l])})) AS n_{l}"
        for l in sorted(PROFILES)
    )
    names = sorted(PROFILES)
    most = "greatest(" + ", ".join(f"n_{l}" for l in names) + ")"
    cases = " ".join(f"WHEN n_{l} = {most} THEN '{l}'" for l in reversed(names))
    return f"""
tokens AS (SELECT {columns}, regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM documents),
hits AS (SELECT {columns}, {hits} FROM tokens),
tagged AS (SELECT {columns}, CASE WHEN {most} = 0 THEN '{UNKNOWN}' {cases} END AS language FROM hits)"""


_METADATA = """
m AS (
  SELECT conv_id, turn, kind, length(text) AS given, turn AS made
  FROM conversations, (SELECT unnest(['openai', 'anthropic', 'gemini', 'no_usage', 'broken', 'none']) AS kind))"""
_COUNTED = "kind IN ('openai', 'anthropic', 'gemini')"

_VERDICT_TEXTS = """
v AS (
  SELECT conv_id, turn, role, length(text) AS n,
         CASE WHEN role = 'user' THEN true
              WHEN role = 'assistant' AND length(text) >= 800 THEN NULL ELSE false END AS valid
  FROM conversations)"""

_COMPARED = f"""{_CTX},
runs AS (
  SELECT conversation_id, company_and_transcript AS b, conversation AS o,
         {_words(_last_line('company_and_transcript'))} AS nb, {_words(_last_line('conversation'))} AS no
  FROM ctx),
compared AS (
  SELECT conversation_id,
         b AS baseline_output_transcript, nb || ' words' AS baseline_explanation,
         CASE WHEN nb % 10 <> 0 THEN CAST(nb >= {BASELINE_WORDS} AS VARCHAR) END AS baseline_satisfied,
         o AS optimized_output_transcript, no || ' words' AS optimized_explanation,
         CASE WHEN no % 10 <> 0 THEN CAST(no >= {OPTIMIZED_WORDS} AS VARCHAR) END AS optimized_satisfied
  FROM runs)"""
_SWITCHED = "baseline_satisfied IS DISTINCT FROM optimized_satisfied"


def _reading_ease(x: str) -> str:
    return f"""round(206.835 - 1.015 * W / greatest(1, len(regexp_extract_all({x}, '[.!?]+'))) - 84.6 * Y / W, 6)"""


_READING = f"""
split_words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws
  FROM documents),
syllables AS (
  SELECT doc_id, text, CAST(len(ws) AS DOUBLE) AS W,
         CAST(list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))) AS DOUBLE) AS Y
  FROM split_words),
scores AS (
  SELECT doc_id, CASE WHEN W > 0 THEN {_reading_ease('text')} END AS reading_ease FROM syllables)"""

_ordered_head = "(SELECT max(doc_id) FROM (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 110))"

_PROGRAM_SYSTEM = (
    f"'Answer True if the last line has at least ' || least || ' words.' || {NL} || {NL} || "
    f"'Input: transcript - transcript to read' || {NL} || 'Output: reasoning, satisfied - True or False' || "
    f"CASE WHEN least = {CANDIDATE_WORDS[0]} THEN {NL} || {NL} || 'Example' || {NL} || "
    f"'transcript: Customer: hi' || {NL} || 'satisfied: False' ELSE '' END"
)


def _histogram(source: str, value: str, width: int) -> str:
    return f"""SELECT CAST(floor({value} / {width}.0) AS BIGINT) AS bin, count(*) AS n,
       CAST(floor({value} / {width}.0) * {width} AS DOUBLE) AS bin_start
FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 3"""


ORACLES: dict[str, str] = {
    "table_counts": """
SELECT 'conversations' AS name, count(*) AS n FROM conversations
UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'labels', count(*) FROM labels""",
    "row_preview": "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 1 OFFSET 4",
    "ingest_seed_messages": f"""
SELECT conv_id || '-' || turn AS conversation_id, text AS "Text", {_words('text')} AS number_of_words
FROM conversations WHERE text IS NOT NULL AND {_words('text')} BETWEEN 20 AND 49""",
    "seed_message_sample": f"""
WITH s AS (
  SELECT conv_id || '-' || turn AS conversation_id, text AS "Text", {_words('text')} AS number_of_words
  FROM conversations WHERE text IS NOT NULL AND {_words('text')} BETWEEN 20 AND 49)
SELECT * FROM s ORDER BY {_draw(0, 'conversation_id')}, conversation_id LIMIT 50""",
    "render_transcripts": f"WITH {_convs()} SELECT conversation_id, company, conversation FROM convs",
    "preprocess_conversations": f"""
WITH {_convs()},
{_tagged('conversation_id, company, text').replace('FROM documents', 'FROM (SELECT *, conversation AS text FROM convs)')}
SELECT conversation_id, company, text AS conversation, {_words('text')} AS conversation_word_count,
       language AS conversation_language
FROM tagged WHERE company IS NULL OR company <> ''""",
    "word_counts": f"SELECT doc_id, {_words('text')} AS conversation_word_count FROM documents",
    "language_tags": f"WITH {_tagged('doc_id')} SELECT doc_id, language FROM tagged",
    "language_confusion": f"""
WITH {_tagged('doc_id, lang')}
SELECT lang AS gold_standard, language AS prediction, count(*) AS n FROM tagged GROUP BY 1, 2""",
    "labelled_examples": f"""
WITH {_EXAMPLES}
SELECT 'example_' || doc_id AS _id, {_strip('transcript')} AS transcript, gold_standard AS satisfied,
       CAST(length(transcript) AS INTEGER) AS n_chars
FROM examples""",
    "parse_turns": f"WITH {_convs()}, {_TURNS} SELECT conversation_id, i, role, content FROM turns",
    "parse_unlabelled_turns": f"""
WITH {_convs(chr(10))}, {_TURNS} SELECT conversation_id, i, role, content FROM turns""",
    "truncate_conversations": f"""
WITH {_convs()}, {_TURNS}, {_truncated(SEED, 1)}
SELECT conversation_id, truncated_conversation FROM truncated""",
    "truncate_with_limits": f"""
WITH {_convs(chr(10))}, {_TURNS}, {_truncated(42, 2, 6)}
SELECT conversation_id, truncated_conversation FROM truncated""",
    "truncation_stats": f"""
WITH {_convs()}, {_TURNS}, {_truncated(SEED, 1)},
counted AS (
  SELECT len(list_filter(string_split(conversation, {NL}), lambda x: trim(x) <> '')) AS o,
         len(list_filter(string_split(truncated_conversation, {NL}), lambda x: trim(x) <> '')) AS t
  FROM truncated)
SELECT round(avg(o), 6) AS avg_original_turns, round(avg(t), 6) AS avg_truncated_turns,
       round((sum(o) - sum(t)) / count(*), 6) AS avg_reduction, count(*) AS total_examples
FROM counted""",
    "truncation_is_reproducible": f"WITH {_convs()} SELECT count(*) AS total, CAST(0 AS BIGINT) AS mismatches FROM convs",
    "split_company_conversation": f"""
WITH {_convs()}
SELECT conversation_id,
       CASE WHEN company IS NULL THEN NULL
            WHEN company = '' THEN 'Conversation' ELSE company END AS company,
       CASE WHEN company IS NULL THEN NULL WHEN company = '' THEN '' ELSE conversation END AS conversation
FROM convs""",
    "judge_context": f"WITH {_CTX} SELECT conversation_id, company_and_transcript FROM ctx",
    "output_transcripts": f"""
WITH {_CTX},
full_text AS (
  SELECT conversation_id,
         CASE WHEN NOT starts_with({_last_line('truncated_conversation')}, 'Agent:')
              THEN company_and_transcript || {NL} || 'Support: Thank you, ' || coalesce(company, 'we') END AS t
  FROM ctx)
SELECT conversation_id, t AS from_text, t AS from_struct FROM full_text""",
    "chat_messages": f"""
WITH {_CTX}
SELECT conversation_id, CAST(0 AS INTEGER) AS position, 'system' AS role, '{REPLY_INSTRUCTION}' AS content FROM ctx
UNION ALL SELECT conversation_id, 1, 'user', company_and_transcript FROM ctx""",
    "flat_prompts": f"""
WITH {_CTX}
SELECT conversation_id, 'openai' AS provider, CAST(NULL AS VARCHAR) AS system, CAST(2 AS INTEGER) AS n_messages,
       '{REPLY_INSTRUCTION}' AS first_message, CAST(NULL AS VARCHAR) AS prompt FROM ctx
UNION ALL SELECT conversation_id, 'anthropic', '{REPLY_INSTRUCTION}', 1, company_and_transcript, NULL FROM ctx
UNION ALL SELECT conversation_id, 'gemini', NULL, 0, NULL,
       'System: {REPLY_INSTRUCTION}' || {NL} || {NL} || 'User: ' || company_and_transcript FROM ctx""",
    "program_prompts": f"""
WITH {_CTX}, {_PROGRAMS}
SELECT conversation_id, 'judge_' || least AS program_id, {_PROGRAM_SYSTEM} AS system_prompt,
       'transcript: ' || company_and_transcript AS user_prompt
FROM ctx CROSS JOIN programs""",
    "normalised_usage": f"""
WITH {_METADATA}
SELECT conv_id, turn, kind, CASE WHEN {_COUNTED} THEN given ELSE 0 END AS input_tokens,
       CASE WHEN {_COUNTED} THEN made ELSE 0 END AS output_tokens
FROM m""",
    "normalised_metadata": f"""
WITH {_METADATA}
SELECT conv_id, turn, kind,
       CASE WHEN kind IN ('openai', 'anthropic') THEN 'c' || conv_id END AS id,
       CASE kind WHEN 'openai' THEN 'm' END AS model,
       CAST(CASE kind WHEN 'openai' THEN 7 END AS BIGINT) AS created,
       CASE kind WHEN 'openai' THEN 'chat' END AS object,
       CASE kind WHEN 'openai' THEN 'stop' WHEN 'anthropic' THEN 'end_turn' END AS finish_reason,
       CASE WHEN kind = 'none' THEN NULL WHEN {_COUNTED} THEN given ELSE 0 END AS prompt_tokens,
       CASE WHEN kind = 'none' THEN NULL WHEN {_COUNTED} THEN made ELSE 0 END AS completion_tokens,
       CASE WHEN kind = 'none' THEN NULL WHEN {_COUNTED} THEN given + made ELSE 0 END AS total_tokens,
       CASE kind WHEN 'no_usage' THEN 'text only' END AS raw,
       CASE kind WHEN 'broken' THEN 'metadata cannot be read' END AS error
FROM m""",
    "structured_verdicts": f"""
WITH {_VERDICT_TEXTS}
SELECT conv_id, turn, valid, CASE WHEN valid THEN n >= 100 END AS satisfied,
       CASE WHEN valid THEN n || ' characters' END AS explanation
FROM v""",
    "program_verdicts": """
SELECT conv_id, turn,
       CASE WHEN role = 'system' THEN NULL WHEN length(text) >= 100 THEN 'true' ELSE ' false ' END AS satisfied,
       CASE WHEN role <> 'system' THEN role END AS explanation
FROM conversations""",
    "infer_text": f"WITH {_ANSWERS} SELECT * FROM answers",
    "infer_structured": f"""
WITH {_CTX},
j AS (SELECT conversation_id, {_FAILS} AS fails, {_IN_WORDS} AS words, {_last_words('company_and_transcript')} AS n FROM ctx),
a AS (
  SELECT *, '{{"satisfied": ' || CAST(n >= 30 AS VARCHAR) || ', "explanation": "last line has ' || n || ' of 30 words"}}' AS answer
  FROM j)
SELECT conversation_id, CASE WHEN NOT fails THEN n >= 30 END AS satisfied,
       CASE WHEN NOT fails THEN 'last line has ' || n || ' of 30 words' END AS explanation,
       CASE WHEN fails THEN 0 ELSE words + 4 END AS input_tokens,
       CASE WHEN fails THEN 0 ELSE {_words('answer')} END AS output_tokens,
       CASE WHEN fails THEN {_BUSY} END AS error
FROM a""",
    "infer_program": f"""
WITH {_CTX}, {_PROGRAMS},
p AS (
  SELECT conversation_id, least, {_PROGRAM_SYSTEM} AS system_prompt,
         'transcript: ' || company_and_transcript AS user_prompt
  FROM ctx CROSS JOIN programs),
j AS (
  SELECT conversation_id, least, {_last_words('user_prompt')} AS n,
         {_words('system_prompt')} + {_words('user_prompt')} AS input_tokens
  FROM p)
SELECT conversation_id, 'judge_' || least AS program_id,
       CASE WHEN n >= least THEN 'true' ELSE 'false' END AS satisfied,
       'last line has ' || n || ' of ' || least || ' words' AS explanation,
       input_tokens, CAST(10 AS BIGINT) AS output_tokens
FROM j""",
    "infer_retries": f"""
WITH {_CTX}, f AS (SELECT *, {_IN_WORDS} % 4 AS failures FROM ctx)
SELECT conversation_id, CAST(least(failures + 1, 3) AS INTEGER) AS attempts,
       CASE WHEN failures = 3 THEN {_BUSY} END AS error,
       CASE WHEN failures < 3 THEN {_REPLY} END AS llm_response
FROM f""",
    "resume_inference": f"""
WITH {_CTX} SELECT conversation_id, {_REPLY} AS llm_response, CAST(NULL AS VARCHAR) AS error FROM ctx""",
    "stored_inference_two_runs": f"""
WITH {_CTX},
c AS (
  SELECT *, CAST(conversation_id AS INTEGER) AS k, {_FAILS} AS fails, {_REPLY} AS reply,
         CASE WHEN CAST(conversation_id AS INTEGER) % 10 <> 0 THEN conversation_id END AS key
  FROM ctx),
asked AS (
  SELECT *, 'first' AS system, 0 AS run, NOT fails AS ok FROM c WHERE k % 3 <> 1
  UNION ALL
  SELECT *, CASE WHEN k % 4 = 0 THEN 'second' ELSE 'first' END, 1, true FROM c WHERE k % 3 <> 0),
final AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id, system ORDER BY ok DESC, run DESC) AS place FROM asked)
SELECT key, conversation_id, CASE WHEN ok THEN reply END AS llm_response, CASE WHEN NOT ok THEN {_BUSY} END AS error
FROM final WHERE place = 1""",
    "stored_inference_empty_start": f"""
WITH {_CTX} SELECT conversation_id, {_REPLY} AS llm_response, CAST(NULL AS VARCHAR) AS error FROM ctx""",
    "misfits_tried_again": f"""
WITH {_CTX}, f AS (SELECT *, {_IN_WORDS} % 4 AS failures, {_last_words('company_and_transcript')} AS n FROM ctx)
SELECT conversation_id, CASE WHEN failures < 3 THEN n >= {BASELINE_WORDS} END AS satisfied,
       CAST(least(failures + 1, 3) AS INTEGER) AS attempts,
       CASE WHEN failures = 3 THEN 'response does not fit the schema' END AS error
FROM f""",
    "call_throughput": f"WITH {_CTX} SELECT count(*) AS calls, true AS took_time, true AS has_rate FROM ctx",
    "turns_with_other_roles": f"""
WITH t AS (
  SELECT conv_id, turn, text,
         CASE WHEN role <> 'assistant' THEN role WHEN turn % 4 < 2 THEN 'agent' ELSE 'tool' END AS role
  FROM conversations),
said AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn,
         CASE role WHEN 'user' THEN 'Customer' WHEN 'agent' THEN 'Support' WHEN 'tool' THEN 'tool' END
           || ': ' || regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g') AS line,
         CASE WHEN role = 'system' THEN regexp_extract(text, '^[A-Za-z]+') END AS company
  FROM t)
SELECT conversation_id, max(company) AS company, string_agg(line, {NL} ORDER BY turn, line) AS conversation
FROM said GROUP BY conversation_id HAVING count(line) > 0""",
    "strict_seed_sample": f"""
SELECT doc_id, doc_id AS key, lang FROM documents WHERE doc_id % 10 <> 0
ORDER BY {_draw(3, 'doc_id')}, CAST(doc_id AS VARCHAR) LIMIT 100""",
    "candidate_scores_by_version": f"WITH {_JUDGED}, {_VERSIONS} SELECT * FROM versions",
    "best_version": f"WITH {_JUDGED}, {_VERSIONS} SELECT * FROM versions ORDER BY score DESC, version LIMIT 1",
    "latest_version_prompts": f"""
SELECT doc_id, 'judge' AS program_id, CAST({len(CANDIDATE_WORDS)} AS INTEGER) AS version,
       'transcript: ' || text AS user_prompt
FROM documents""",
    "synthesis_job": f"""
WITH s AS (
  SELECT conv_id || '-' || turn AS conversation_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS message,
         {_words('text')} AS n
  FROM conversations WHERE {_words('text')} BETWEEN 20 AND 49)
SELECT conversation_id, 'Acme ' || n AS company,
       'Customer: ' || message || {NL} || 'Support: One moment please: we check.' AS conversation,
       n + {_n_words(SYNTHESIS_INSTRUCTION)} AS input_tokens, n + 11 AS output_tokens
FROM s""",
    "generation_job": f"""
WITH {_CTX}
SELECT conversation_id, company_and_transcript || {NL} || 'Support: ' || {_REPLY} AS output_transcript FROM ctx""",
    "program_generation_job": f"""
WITH {_CTX}
SELECT conversation_id, company_and_transcript || {NL} || 'Support: ' || {_PROGRAM_REPLY} AS output_transcript
FROM ctx""",
    "resumed_judge_job": f"""
WITH {_CTX}, r AS (SELECT conversation_id, {_REPLY_WORDS} + 1 AS n FROM ctx)
SELECT conversation_id, n >= 12 AS satisfied, 'last line has ' || n || ' of 12 words' AS explanation FROM r""",
    "current_answers": f"""
WITH {_CTX} SELECT conversation_id, {_REPLY} AS llm_response, CAST(NULL AS VARCHAR) AS error FROM ctx""",
    "judge_job": f"""
WITH {_CTX}, r AS (SELECT conversation_id, {_REPLY_WORDS} + 1 AS n FROM ctx)
SELECT conversation_id, n >= 12 AS satisfied, 'last line has ' || n || ' of 12 words' AS explanation FROM r""",
    "token_statistics": f"WITH {_ANSWERS} SELECT {_STATISTICS} FROM answers",
    "success_rate": f"""
WITH {_ANSWERS}
SELECT count(*) AS total, round(count(*) FILTER (error IS NULL) / count(*), 6) AS success_rate FROM answers""",
    "provider_comparison": f"""
WITH {_ANSWERS},
asked AS (
  SELECT provider,
         CASE WHEN provider = 'gemini' AND {_FAILS} THEN 0
              ELSE {_IN_WORDS} + {_n_words(REPLY_INSTRUCTION)} END AS input_tokens,
         CASE WHEN provider = 'gemini' AND {_FAILS} THEN 0 ELSE {_REPLY_WORDS} END AS output_tokens
  FROM ctx, (SELECT unnest(['openai', 'anthropic', 'gemini']) AS provider))
SELECT provider, {_STATISTICS} FROM asked GROUP BY provider""",
    "verdict_distribution": f"""
WITH {_convs()},
v AS (
  SELECT CASE WHEN NOT starts_with({_last_line('conversation')}, 'Agent:')
              THEN {_words(_last_line('conversation'))} >= {BASELINE_WORDS} END AS satisfied
  FROM convs),
c AS (
  SELECT count(*) AS total, count(*) FILTER (satisfied) AS t, count(*) FILTER (NOT satisfied) AS f FROM v),
rows_ AS (SELECT 0 AS position, 'true' AS satisfied, t AS n, total FROM c
          UNION ALL SELECT 1, 'false', f, total FROM c)
SELECT CAST(position AS INTEGER) AS position, satisfied, n,
       CASE WHEN n > 0 THEN round(100 * n / total, 1) END AS percent
FROM rows_""",
    "verdict_agreement": f"""
WITH {_PAIRS}
SELECT count(*) AS total, round(avg(CASE WHEN prediction = gold_standard THEN 1 ELSE 0 END), 6) AS agreement
FROM pairs""",
    "confusion_matrix": f"""
WITH {_PAIRS} SELECT gold_standard, prediction, count(*) AS n FROM pairs GROUP BY 1, 2""",
    "cohen_kappa": f"WITH {_PAIRS}, {_KAPPA}",
    "judge_agreement_on_truncated": f"""
WITH {_CTX},
pairs AS (
  SELECT {_words(_last_line('company_and_transcript'))} >= {BASELINE_WORDS} AS prediction,
         {_words(_last_line('company_and_transcript'))} >= 30 AS gold_standard
  FROM ctx), {_KAPPA}""",
    "judge_metric": f"""
WITH said AS (
  SELECT doc_id, text, quality, {_words('text')} AS n FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST((n >= 50) = (quality = 1) AS INTEGER) AS metric,
       CAST(n >= {GOLD_WORDS} AS INTEGER) AS judged_true,
       CASE WHEN doc_id % 3 = 2 THEN 'shown: ' || text ELSE nullif(text, '') END AS judged_transcript
FROM said""",
    "program_evaluation": f"""
WITH {_JUDGED} {_SCORES} WHERE least = {CANDIDATE_WORDS[1]} GROUP BY program_id""",
    "generator_evaluation": f"""
WITH {_CTX}, r AS (SELECT {_PROGRAM_REPLY} AS reply FROM ctx)
SELECT 'reply' AS program_id, CAST(1 AS INTEGER) AS version, count(*) AS examples,
       round(100 * avg(CASE WHEN {_words('reply')} + 1 >= {CANDIDATE_WORDS[0]} THEN 1 ELSE 0 END), 6) AS score
FROM r""",
    "length_histogram": f"WITH d AS (SELECT {_words('text')} AS n_words FROM documents) "
    + _histogram("d", "n_words", 50),
    "readability": f"WITH {_READING} SELECT doc_id, reading_ease FROM scores",
    "readability_histogram": f"WITH {_READING} " + _histogram("scores", "reading_ease", 10),
    "compared_runs": f"WITH {_COMPARED} SELECT * FROM compared",
    "switched_verdicts": f"WITH {_COMPARED} SELECT * FROM compared WHERE {_SWITCHED}",
    "switched_summary": f"""
WITH {_COMPARED}
SELECT optimized_satisfied, count(*) AS n FROM compared WHERE {_SWITCHED} GROUP BY 1""",
    "switched_report": f"""
WITH {_COMPARED} SELECT * FROM compared WHERE {_SWITCHED} ORDER BY optimized_satisfied, conversation_id""",
    "seeded_sample": f"""
SELECT doc_id, lang, n_chars FROM documents
ORDER BY {_draw(10, 'doc_id')}, CAST(doc_id AS VARCHAR) LIMIT 400""",
    "train_test_split": f"""
WITH r AS (
  SELECT *, row_number() OVER (ORDER BY {_draw(10, 'doc_id')}, CAST(doc_id AS VARCHAR)) AS place,
         count(*) OVER () AS total
  FROM labels)
SELECT doc_id, quality, toxic, CASE WHEN place <= ceil(total * CAST(0.4 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM r""",
    "hash_split": f"""
SELECT doc_id, quality, toxic,
       CASE WHEN {_draw(10, 'doc_id')} < {int(0.4 * 2**32)} THEN 'test' ELSE 'train' END AS split
FROM labels""",
    "ordered_slice": f"""
SELECT doc_id, quality, toxic, CASE WHEN doc_id <= {_ordered_head} THEN 'training' ELSE 'validation' END AS part
FROM labels""",
    "candidate_scores": f"WITH {_JUDGED} {_SCORES} GROUP BY program_id",
    "best_candidate": f"""
WITH {_JUDGED} {_SCORES} GROUP BY program_id ORDER BY score DESC, program_id LIMIT 1""",
    "demo_selection": f"""
WITH {_JUDGED},
ranked AS (
  SELECT program_id, gold_standard, doc_id,
         row_number() OVER (PARTITION BY program_id, gold_standard ORDER BY {_draw(SEED, 'doc_id')}, doc_id) AS rank
  FROM scored WHERE metric = 1)
SELECT program_id, gold_standard, CAST(rank AS INTEGER) AS rank, doc_id FROM ranked WHERE rank <= 2""",
}
