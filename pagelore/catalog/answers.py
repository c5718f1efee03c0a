"""Registered queries: steps of the batch Q&A."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.catalog import views as v
from pagelore.catalog.registry import Tables, query
from pagelore.catalog.retrieval import corpus, ctes
from pagelore.catalog.scoring import echo_generator, empty_cache
from pagelore.functions import text
from pagelore.operators import qa, vectors
from pagelore.plans.answering import Prompts, answer_batch
from pagelore.plans.search import SearchConfig, search

N = "CAST(count(*) AS BIGINT)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# --- Questions --------------------------------------------------------------------

PASTED = "concat(text, ' my key is sk_test_a', CAST(doc_id AS STRING), ', whsec_B9 too ') AS text"


@query("q1_redact_secrets", f"""SELECT doc_id, {v.STRIP_SQL.format(
    f"regexp_replace(text, '{fx.SECRET_PATTERN}', '[redacted key]', 'g')")} AS text
  FROM (SELECT doc_id, {PASTED} FROM documents)""")
def q1(t: Tables):
    return t.documents.selectExpr("doc_id", PASTED).select("doc_id", text.redact_secrets(F.col("text")).alias("text"))


@query("q1_redact_emails", f"""SELECT doc_id, {v.STRIP_SQL.format(
    f"regexp_replace(text, '{EMAIL}', '[email]', 'g')")} AS text FROM documents""")
def q1_emails(t: Tables):
    return t.documents.select("doc_id", text.redact_secrets(F.col("text"), EMAIL, "[email]").alias("text"))


@query("q2_cap_length", f"""SELECT doc_id, {v.STRIP_SQL.format('text')} AS text FROM documents
  WHERE length(text) <= 1500""")
def q2(t: Tables):
    return qa.prepare_questions(t.documents.select("doc_id", "text"), "text")


# --- Routing ------------------------------------------------------------------------

# A router reply per message; its shape follows the kind of event.
REPLIES = ["event_id AS qid", "concat('question ', event_type, ' ', CAST(event_id AS STRING)) AS question", """CASE event_type
    WHEN 'click' THEN concat('Here: {"in_scope": true, "sub_questions": ["  part a ', CAST(event_id AS STRING),
      '", "part b", 7, "", "part c", "part d"], "sandbox_flow": "hold_and_capture", "sandbox_params": {"amount_cents": ',
      CAST(CAST(floor(value * 100) AS BIGINT) AS STRING), ', "other": 1}, "reason": "two asks"} done')
    WHEN 'view' THEN '{"in_scope": true, "sub_questions": [], "sandbox_flow": "no_such_flow", "sandbox_params": {"a": 1}}'
    WHEN 'purchase' THEN concat('{"in_scope": 1, "sub_questions": ["buy"], "sandbox_flow": "declined_card", "sandbox_params": {"decline_type": "',
      CASE WHEN event_id % 2 = 0 THEN 'insufficient_funds' ELSE 'stolen' END, '"}}')
    WHEN 'signup' THEN '{"in_scope": false, "sub_questions": [], "sandbox_flow": "charge_card", "sandbox_params": {}, "reason": "unrelated"}'
    ELSE '{"in_scope": true, "sub_questions": ["cut off' END AS raw"""]
KNOWN = ", ".join(f"'{key}'" for key, _ in fx.FLOW_PATTERNS)
v.define("replies_v", f"SELECT {', '.join(REPLIES)} FROM events")
v.define("spans_v", r"""SELECT qid, question, raw, CASE WHEN json_valid(s) THEN s END AS s FROM (
  SELECT *, regexp_extract(raw, '(?s)\{.*\}') AS s FROM replies_v)""", "replies_v")
v.define("routed_v", r"""SELECT qid, question, raw, s, s IS NULL AS failed,
    CASE WHEN s IS NULL THEN true ELSE coalesce(json_extract_string(s, '$.in_scope') NOT IN ('false', '0'), false) END AS in_scope,
    list_filter(list_transform(list_filter(CAST(json_extract(s, '$.sub_questions') AS JSON[]),
      lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(json_extract_string(x, '$'))), lambda x: x <> '')[1:3] AS subs
  FROM spans_v""", "spans_v")
v.define("chosen_v", f"""SELECT *, CASE WHEN in_scope AND NOT failed AND json_extract_string(s, '$.sandbox_flow') IN ({KNOWN})
    THEN json_extract_string(s, '$.sandbox_flow') END AS flow FROM routed_v""", "routed_v")


def replies(t: Tables):
    return t.events.selectExpr(*REPLIES)


def chosen(t: Tables):
    return qa.validate_flow_choice(qa.parse_route(replies(t)), [key for key, _ in fx.FLOW_PATTERNS])


@query("q3_parse_route", v.with_views("routed_v", body="""
SELECT qid, in_scope, array_to_string(CASE WHEN failed OR (in_scope AND len(subs) = 0) THEN [question] ELSE subs END, '|') AS sub_questions,
  CASE WHEN failed THEN 'router error, fail-open' ELSE coalesce(json_extract_string(s, '$.reason'), '') END AS reason,
  CASE WHEN failed THEN 'unreadable router reply' END AS route_error FROM routed_v"""))
def q3(t: Tables):
    return qa.parse_route(replies(t)).select(
        "qid", "in_scope", F.array_join("sub_questions", "|").alias("sub_questions"), "reason", "route_error")


@query("q4_gate_scope", v.with_views("routed_v", body="""
SELECT qid, CASE WHEN in_scope THEN 'retrieve' ELSE 'refused' END AS gate FROM routed_v"""))
def q4(t: Tables):
    wanted, refused = qa.gate_scope(qa.parse_route(replies(t)))
    return wanted.select("qid", F.lit("retrieve").alias("gate")).unionByName(
        refused.select("qid", F.lit("refused").alias("gate")))


@query("q5_validate_flow_choice", v.with_views("chosen_v", body="""
SELECT qid, flow AS sandbox_flow, CASE WHEN flow IS NOT NULL AND json_type(s, '$.sandbox_params') = 'OBJECT'
  THEN CAST(len(json_keys(s, '$.sandbox_params')) AS INT) ELSE 0 END AS n_params FROM chosen_v"""))
def q5(t: Tables):
    return chosen(t).select("qid", "sandbox_flow", F.coalesce(
        F.size(F.map_keys(F.from_json("sandbox_params", "map<string,variant>"))), F.lit(0)).alias("n_params"))


SPEC_ROWS = ", ".join(
    f"('{f}', '{n}', '{k}', '{d}', {lo}, {hi}, {list(c)!r})" for f, n, k, d, lo, hi, c in fx.FLOW_PARAMS)


@query("q6_coerce_params", v.with_views("chosen_v", body=f"""
SELECT qid, flow AS sandbox_flow, name, CASE WHEN kind = 'choice'
    THEN CASE WHEN list_contains(choices, given) THEN given ELSE fallback END
    ELSE coalesce(CAST(greatest(lo, least(hi, TRY_CAST(given AS BIGINT))) AS VARCHAR), fallback) END AS value
FROM (SELECT qid, flow, name, kind, fallback, lo, hi, choices,
    json_extract_string(s, '$.sandbox_params.' || name) AS given
  FROM chosen_v JOIN (VALUES {SPEC_ROWS}) p(key, name, kind, fallback, lo, hi, choices) ON key = flow)""".replace(
    "greatest(lo, least(hi, TRY_CAST(given AS BIGINT)))",
    "CASE WHEN TRY_CAST(given AS BIGINT) IS NOT NULL THEN greatest(lo, least(hi, TRY_CAST(given AS BIGINT))) END")))
def q6(t: Tables):
    return qa.coerce_params(chosen(t), qa.flow_param_specs(t.spark), ["qid"])


ASKED = """CASE event_type
    WHEN 'click' THEN concat('Can I place a HOLD and capture ', CAST(event_id AS STRING), ' later?')
    WHEN 'view' THEN 'how to share a payment link for my plan'
    WHEN 'purchase' THEN 'give the money back after a chargeback'
    WHEN 'signup' THEN 'what happens when a card has insufficient funds'
    ELSE concat('tell me about item ', CAST(event_id AS STRING)) END"""
LADDER = "CASE " + " ".join(
    f"WHEN regexp_matches(question, '(?i){pattern}') THEN '{key}'" for key, pattern in fx.FLOW_PATTERNS) + " END"


@query("q7_match_flow", f"""SELECT id, {LADDER} AS flow FROM (SELECT event_id AS id, {ASKED} AS question FROM events)
  UNION ALL SELECT conv_id * 1000 + turn + 1000000000, {LADDER} FROM (SELECT conv_id, turn, text AS question FROM conversations)""")
def q7(t: Tables):
    asked = t.events.selectExpr("event_id AS id", f"{ASKED} AS question").unionByName(
        t.conversations.selectExpr("conv_id * 1000 + turn + 1000000000 AS id", "text AS question"))
    return asked.select("id", qa.match_flow(F.col("question")).alias("flow"))


EXCHANGE = ["event_id AS id", f"{ASKED} AS question",
            "CASE WHEN event_type = 'error' THEN 'error' ELSE 'docs' END AS route",
            "concat('**Code sample**', CASE WHEN value > 10 THEN concat(chr(10), '   ```js', chr(10), 'x', chr(10), '   ```') ELSE ' `x`' END) AS answer",
            "CASE WHEN event_id % 3 = 0 THEN 'charge_card' END AS flow",
            "CASE WHEN event_id % 2 = 0 THEN 'router down' END AS route_error"]


@query("q8_choose_flow", f"""SELECT id, CASE WHEN route = 'docs' AND value > 10 THEN
    CASE WHEN flow IS NOT NULL THEN flow WHEN route_error IS NOT NULL THEN {LADDER} END END AS sandbox_flow
  FROM (SELECT {', '.join(EXCHANGE)}, value FROM events)""")
def q8(t: Tables):
    return t.events.selectExpr(*EXCHANGE).select("id", qa.choose_flow(
        F.col("route"), F.col("answer"), F.col("flow"), F.col("route_error"), F.col("question")).alias("sandbox_flow"))


# --- Generation ----------------------------------------------------------------------

def _hash_sql(*cols: str) -> str:
    parts = [f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '~')" for c in cols]
    return f"sha256(concat_ws(';', {', '.join(parts)}))"


REQUESTS = ["conv_id * 1000 + turn AS request_id", "role AS system", "text AS user",
            "CAST(0 AS DOUBLE) AS temperature", "CAST(NULL AS STRING) AS model"]
KEY_SQL = _hash_sql("role", "text", "'0.0'", "CAST(NULL AS VARCHAR)")


def requests(t: Tables):
    return t.conversations.selectExpr(*REQUESTS)


def cache(t: Tables):
    """Replies known from before: those to every opening turn; some are damaged."""
    opening = qa.with_cache_key(t.conversations.where("turn = 0").selectExpr(*REQUESTS))
    return opening.groupBy("cache_key").agg(F.min("request_id").alias("r")).select(
        "cache_key", F.lit("cached").alias("provider"), F.lit("old-1").alias("model"),
        F.when(F.col("r") % 2 == 0, F.concat(F.lit("old answer "), F.col("r"))).alias("text"),
        F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"))


CACHE_SQL = f"""
WITH keyed AS (SELECT conv_id * 1000 + turn AS request_id, turn, role AS system, text AS "user", {KEY_SQL} AS cache_key
  FROM conversations),
cache AS (SELECT cache_key, 'old answer ' || CAST(min(request_id) AS VARCHAR) AS text FROM keyed WHERE turn = 0
  GROUP BY cache_key HAVING min(request_id) % 2 = 0)"""


@query("q9_split_cached", CACHE_SQL + f"""
SELECT 'hit' AS kind, cache_key, {N} AS requests FROM keyed JOIN cache USING (cache_key) GROUP BY cache_key
UNION ALL SELECT 'miss', cache_key, 1 FROM (SELECT DISTINCT cache_key FROM keyed
  WHERE cache_key NOT IN (SELECT cache_key FROM cache))""")
def q9_split(t: Tables):
    hits, misses = qa.split_cached(requests(t), cache(t))
    return hits.groupBy("cache_key").agg(F.count(F.lit(1)).alias("requests")).select(
        F.lit("hit").alias("kind"), "cache_key", "requests").unionByName(
        misses.select(F.lit("miss").alias("kind"), "cache_key", F.lit(1).cast("long").alias("requests")))


@query("q9_cached_generate", CACHE_SQL + """
SELECT request_id, c.cache_key IS NOT NULL AS cached, coalesce(c.text, left(system, 2) || ' [' ||
    CAST(length("user") % 9 AS VARCHAR) || '] about ' || CAST(length("user") AS VARCHAR) || ' characters') AS text,
  CASE WHEN c.cache_key IS NOT NULL THEN 10 ELSE CAST(length(system) + length("user") AS INT) END AS prompt_tokens
FROM keyed LEFT JOIN cache c USING (cache_key)""")
def q9(t: Tables):
    answers, _ = qa.cached_generate(requests(t), cache(t), echo_generator)
    return answers.select("request_id", "cached", "text", "prompt_tokens")


@query("q10_total_tokens", v.with_views("messages_v", body="""
SELECT id, CASE WHEN prompt_tokens IS NULL AND c IS NULL THEN NULL
  ELSE coalesce(prompt_tokens, 0) + coalesce(c, 0) END AS total_tokens
FROM (SELECT id, prompt_tokens, CASE WHEN cached THEN NULL ELSE completion_tokens END AS c FROM messages_v)"""))
def q10(t: Tables):
    given = F.when(F.col("cached"), F.lit(None)).otherwise(F.col("completion_tokens"))
    return v.messages(t).select("id", qa.total_tokens(F.col("prompt_tokens"), given).alias("total_tokens"))


# --- Context and citations --------------------------------------------------------------

HITS_5 = ctes("vec", "chunks_v", tail="""
, hits AS (SELECT qid, rank, page_url, page_title, heading_path, content FROM vec JOIN chunks_v USING (chunk_id)
  WHERE rank <= 5)""")
RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def hits(t: Tables):
    return search(v.queries(t), corpus(t, SearchConfig(None)), SearchConfig(None, top_k=5))


@query("q11_context_block", HITS_5 + f"""
SELECT qid, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || page_title || ' — ' || heading_path || chr(10)
  || 'Source: ' || page_url || chr(10) || chr(10)
  || CASE WHEN length(content) > 4000 THEN left(content, 4000) || chr(10) || '[… excerpt truncated]' ELSE content END,
  {RULE} ORDER BY rank) AS context FROM hits GROUP BY qid""")
def q11(t: Tables):
    return qa.context_block(hits(t))


@query("q12_judge_context", HITS_5 + f"""
SELECT qid, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || page_url || chr(10) || left(content, 3000),
  {RULE} ORDER BY rank) AS context FROM hits GROUP BY qid""")
def q12(t: Tables):
    return qa.judge_context(hits(t))


@query("q13_question_block", """
SELECT conv_id, CASE WHEN n <= 1 THEN question ELSE question || chr(10) || chr(10) || 'This question has '
  || CAST(n AS VARCHAR) || ' parts:' || chr(10) || parts || chr(10) || chr(10)
  || 'Answer each part under its own markdown heading.' END AS block
FROM (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS question,
    string_agg(CAST(i AS VARCHAR) || '. ' || text, chr(10) ORDER BY i) AS parts
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user')
  GROUP BY conv_id)""")
def q13(t: Tables):
    asked = t.conversations.where("role = 'user'").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    parts = asked.select("conv_id", F.transform("turns", lambda r: r["text"]).alias("parts"))
    return parts.select("conv_id", qa.question_block(F.col("parts")[0], F.col("parts")).alias("block"))


def router_and_answers():
    """Deterministic stand-in for both calls of a question."""
    echo = echo_generator()

    def call(frame):
        out = echo(frame)
        for row, system, user in zip(out, frame["system"], frame["user"]):
            if system == "route":
                words = user.split()
                half = len(words) // 2
                row["text"] = json.dumps({
                    "in_scope": len(words) % 5 != 0,
                    "sub_questions": [" ".join(words[:half]), " ".join(words[half:])] if half % 2 else [user],
                    "sandbox_flow": "charge_card", "sandbox_params": {}, "reason": "test"})
        return out

    return call


@query("q14_answer_batch")
def q14(t: Tables):
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    out = answer_batch(
        asked, corpus(t), SearchConfig("any", top_k=10),
        Prompts(router="route", answer="answer from the excerpts"), empty_cache(t),
        router_and_answers, vectors.hashed_term_encoder(64))
    return out.select("qid", "question", "answer", "route", F.size("retrieved").alias("n_retrieved"),
                      "provider", "model", "prompt_tokens", "completion_tokens", "cached", "error", "sandbox_flow")


CITED = """CASE role WHEN 'assistant' THEN concat(text, ' [', CAST(turn AS STRING), '] and [', CAST(conv_id AS STRING), ']')
  ELSE text END"""


@query("q15_extract_citations", f"""SELECT conv_id, turn, regexp_matches(answer, '\\[\\d+\\]') AS cited,
    array_to_string(regexp_extract_all(answer, '\\[\\d+\\]'), '') AS markers
  FROM (SELECT conv_id, turn, {CITED} AS answer FROM conversations)""")
def q15(t: Tables):
    rows = t.conversations.selectExpr("conv_id", "turn", f"{CITED} AS answer")
    return rows.select("conv_id", "turn", text.has_citation(F.col("answer")).alias("cited"),
                       F.array_join(text.extract_citations(F.col("answer")), "").alias("markers"))


@query("q16_group_citations", HITS_5.replace("rank <= 5", "rank <= 20") + """
SELECT qid, page_url, arg_min(page_title, rank) AS page_title,
  string_agg('[' || CAST(rank AS VARCHAR) || ']', '' ORDER BY rank) AS markers, CAST(min(rank) AS BIGINT) AS first_index,
  CASE WHEN count(DISTINCT heading_path) = 1 THEN min(heading_path) END AS heading
FROM hits GROUP BY qid, page_url""")
def q16(t: Tables):
    found = search(v.queries(t), corpus(t, SearchConfig(None)), SearchConfig(None, top_k=20))
    return qa.group_citations(found).withColumn("first_index", F.col("first_index").cast("long"))


@query("q17_has_code", f"""SELECT id, value > 10 AS has_code,
    CASE WHEN value > 10 THEN answer ELSE replace(answer, '**Code sample**', '**Steps**') END AS answer
  FROM (SELECT {', '.join(EXCHANGE)}, value FROM events)""")
def q17(t: Tables):
    rows = t.events.selectExpr(*EXCHANGE)
    return rows.select("id", text.has_code(F.col("answer")).alias("has_code"),
                       text.retitle_without_code(F.col("answer")).alias("answer"))


# --- Event trail ----------------------------------------------------------------------

# Events with their five ids; a run is a signup, its ids are the user and the key it names.
TRAIL = ["event_id",
         "CASE event_type WHEN 'signup' THEN 'customer.created' WHEN 'purchase' THEN 'charge.succeeded' WHEN 'click' THEN 'payment_intent.created' ELSE event_type END AS type",
         "CAST(floor(event_id / 10) AS BIGINT) AS created", "concat('evt_', CAST(event_id AS STRING)) AS object_id",
         "concat('pi_', CAST(floor(event_id / 4) AS BIGINT)) AS payment_intent",
         "CASE WHEN event_type = 'view' THEN concat('sub_', CAST(user_id AS STRING)) END AS subscription",
         "CASE WHEN event_type <> 'error' THEN concat('cus_', CAST(user_id AS STRING)) END AS customer",
         "CASE WHEN event_type = 'purchase' THEN concat('seti_', CAST(floor(event_id / 8) AS BIGINT)) END AS setup_intent"]
REFS = {"obj": "concat('evt_', CAST(event_id + 3 AS STRING))", "pi": "concat('pi_', CAST(floor(event_id / 4) AS BIGINT))",
        "sub": "concat('sub_', CAST(user_id AS STRING))", "cus": "concat('cus_', CAST(user_id AS STRING))",
        "seti": "concat('seti_', CAST(floor(event_id / 8) AS BIGINT))"}
TOUCHED = ["event_id AS run_id", "CAST(floor(event_id / 10) AS BIGINT) AS window_start",
           "CAST(floor(event_id / 10) + 250 AS BIGINT) AS window_end", *(f"{e} AS {n}" for n, e in REFS.items())]
STEPS_SQL = "[" + ", ".join(f"'{s}'" for s in fx.EVENT_LIFECYCLE) + "]"


@query("q18_correlate_events", f"""
WITH trail AS (SELECT {', '.join(TRAIL)} FROM events),
runs AS (SELECT {', '.join(TOUCHED)} FROM events WHERE event_type = 'signup')
SELECT run_id, event_id, type, created,
  CAST(coalesce(list_position({STEPS_SQL}, type) - 1, {len(fx.EVENT_LIFECYCLE)}) AS BIGINT) AS lifecycle_pos
FROM runs JOIN trail ON created BETWEEN window_start AND window_end
  AND (object_id = obj OR payment_intent = pi OR subscription = sub OR customer = cus OR setup_intent = seti)""")
def q18(t: Tables):
    runs = t.events.where("event_type = 'signup'").selectExpr(*TOUCHED)
    touched = runs.select("run_id", "window_start", "window_end", F.explode(F.array(*REFS)).alias("ref_id"))
    return qa.correlate_events(t.events.selectExpr(*TRAIL), touched, bin_width=100)


@query("q19_drop_null_fields", v.with_views("messages_v", body="""
SELECT id, '{"route":"' || route || '"' || coalesce(',"provider":"' || provider || '"', '')
  || coalesce(',"tokens":' || CAST(prompt_tokens AS VARCHAR), '')
  || ',"flows":[' || coalesce('"' || sandbox_flow || '"', 'null') || ',"end"]}' AS trace FROM messages_v"""))
def q19(t: Tables):
    value = F.struct(
        "route", "provider", F.col("prompt_tokens").alias("tokens"),
        F.array("sandbox_flow", F.lit("end")).alias("flows"))
    return v.messages(t).select("id", qa.drop_null_fields(value).alias("trace"))
