"""Registered queries: dashboard aggregates over the message log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.catalog import views as v
from pagelore.catalog.registry import QUERIES, Tables, query
from pagelore.operators import monitoring as m

N = "CAST(count(*) AS BIGINT)"


@query("m1_questions_per_hour", v.with_views("messages_v", body="").rstrip() + """
, counts AS (SELECT CAST(date_trunc('hour', asked_at) AS TIMESTAMP) AS time, count(*) AS n FROM messages_v GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM counts)
SELECT time, CAST(coalesce(n, 0) AS BIGINT) AS questions FROM spine LEFT JOIN counts USING (time)""")
def m1(t: Tables):
    return m.questions_per_hour(v.messages(t))


def filled_sql(metric: str, where: str = "true") -> str:
    return v.with_views("messages_v", body="").rstrip() + f"""
, counts AS (SELECT CAST(date_trunc('day', asked_at) AS TIMESTAMP) AS time, {metric} AS metric, count(*) AS n
  FROM messages_v WHERE {where} GROUP BY 1, 2),
spine AS (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS time FROM counts),
series AS (SELECT DISTINCT metric FROM counts)
SELECT time, metric, CAST(coalesce(n, 0) AS BIGINT) AS value
FROM spine CROSS JOIN series LEFT JOIN counts USING (time, metric)"""


@query("m2_outcomes_per_day", filled_sql(
    "CASE route WHEN 'docs' THEN 'Answered' WHEN 'refused' THEN 'Refused' WHEN 'error' THEN 'Failed' ELSE route END"))
def m2(t: Tables):
    return m.outcomes_per_day(v.messages(t))


@query("m3_recent_questions", v.with_views("messages_v", "rated_v", body="""
SELECT asked_at AS asked, left(question, 70) AS question, route, coalesce(provider, '') AS provider,
  coalesce(model, '') AS model, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS tokens,
  CASE WHEN cached THEN 'cache' ELSE '' END AS "from", latency_ms AS ms,
  coalesce(CAST(rating AS VARCHAR), '') AS rating
FROM messages_v LEFT JOIN rated_v ON message_id = id ORDER BY asked_at DESC, id DESC LIMIT 25"""))
def m3(t: Tables):
    return m.recent_questions(v.messages(t), v.feedback(t))


@query("m4_demo_share", v.with_views("messages_v", body="""
SELECT round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE sandbox_flow IS NOT NULL) / nullif(count(*), 0), 1) AS value
FROM messages_v WHERE route = 'docs'"""))
def m4(t: Tables):
    return m.demo_share(v.messages(t))


@query("m5_demo_vs_answer_only", filled_sql(
    "CASE WHEN sandbox_flow IS NOT NULL THEN 'Runnable demo offered' ELSE 'Answer only' END", "route = 'docs'"))
def m5(t: Tables):
    return m.demo_vs_answer_only(v.messages(t))


@query("m6_flow_demand", v.with_views("messages_v", body=f"""
SELECT sandbox_flow AS flow, {N} AS times_offered FROM messages_v WHERE sandbox_flow IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1"""))
def m6(t: Tables):
    return m.flow_demand(v.messages(t))


@query("m7_api_calls_per_day", v.with_views("messages_v", body="").rstrip() + f"""
, calls AS (SELECT asked_at, model, 'answer' AS call_type FROM messages_v
    WHERE model IS NOT NULL AND coalesce(cached, false) = false
  UNION ALL SELECT asked_at, json_extract_string(router, '$.usage.model'), 'routing' FROM messages_v
    WHERE json_extract_string(router, '$.usage.model') IS NOT NULL
      AND coalesce(CAST(json_extract_string(router, '$.usage.cached') AS BOOLEAN), false) = false)
SELECT CAST(date_trunc('day', asked_at) AS TIMESTAMP) AS time, model || ' · ' || call_type AS metric, {N} AS value
FROM calls GROUP BY 1, 2""")
def m7(t: Tables):
    return m.api_calls_per_day(v.messages(t))


def _billed(field: str) -> str:
    return f"""CAST(sum(CASE WHEN coalesce(cached, false) THEN 0 ELSE coalesce({field}, 0) END
    + CASE WHEN coalesce(CAST(json_extract_string(router, '$.usage.cached') AS BOOLEAN), false) THEN 0
      ELSE coalesce(CAST(json_extract_string(router, '$.usage.{field}') AS INT), 0) END) AS BIGINT) AS {field}"""


@query("m8_token_spend_per_day", v.with_views("messages_v", body=f"""
SELECT CAST(date_trunc('day', asked_at) AS TIMESTAMP) AS time, {_billed('prompt_tokens')}, {_billed('completion_tokens')}
FROM messages_v GROUP BY 1"""))
def m8(t: Tables):
    return m.token_spend_per_day(v.messages(t))


@query("m9_provider_per_day", v.with_views("messages_v", body=f"""
SELECT CAST(date_trunc('day', asked_at) AS TIMESTAMP) AS time, provider AS metric, {N} AS value
FROM messages_v WHERE provider IS NOT NULL GROUP BY 1, 2"""))
def m9(t: Tables):
    return m.provider_per_day(v.messages(t))


def latency_sql(where: str) -> str:
    return v.with_views("messages_v", body=f"""
SELECT CAST(date_trunc('hour', asked_at) AS TIMESTAMP) AS time, round(avg(latency_ms), 6) AS avg_ms,
  round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 6) AS p95_ms
FROM messages_v WHERE latency_ms IS NOT NULL AND {where} GROUP BY 1""")


def _latency(rows):
    return rows.select("time", F.round("avg_ms", 6).alias("avg_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@query("m10_latency_per_hour", latency_sql("true"))
def m10(t: Tables):
    return _latency(m.latency_per_hour(v.messages(t)))


@query("m10_latency_without_errors", latency_sql("route <> 'error'"))
def m10_clean(t: Tables):
    return _latency(m.latency_per_hour(v.messages(t), count_errors=False))


@query("m11_top_score_per_hour", v.with_views("messages_v", body="""
SELECT CAST(date_trunc('hour', asked_at) AS TIMESTAMP) AS time,
  round(avg(CAST(json_extract_string(retrieved_chunks, '$[0].score') AS DOUBLE)), 6) AS top_score
FROM messages_v WHERE json_array_length(retrieved_chunks) > 0 GROUP BY 1"""))
def m11(t: Tables):
    return m.top_score_per_hour(v.messages(t)).withColumn("top_score", F.round("top_score", 6))


@query("m12_rated_answers", v.with_views("messages_v", "rated_v", body="""
SELECT asked_at AS asked, CASE rating WHEN 1 THEN '👍 good' ELSE '👎 bad' END AS verdict,
  left(question, 70) AS question, coalesce(model, '') AS model, latency_ms AS ms
FROM rated_v JOIN messages_v ON id = message_id ORDER BY rating, asked_at DESC, id DESC LIMIT 25"""))
def m12(t: Tables):
    return m.rated_answers(v.messages(t), v.feedback(t))


# --- The same panels over a time range of the stored log -------------------------------

RANGE = ("2024-01-05 06:00:00", "2024-01-12 18:30:00")
PANELS = {
    "m1_questions_per_hour": m.questions_per_hour, "m2_outcomes_per_day": m.outcomes_per_day,
    "m4_demo_share": m.demo_share, "m5_demo_vs_answer_only": m.demo_vs_answer_only, "m6_flow_demand": m.flow_demand,
    "m7_api_calls_per_day": m.api_calls_per_day, "m8_token_spend_per_day": m.token_spend_per_day,
    "m9_provider_per_day": m.provider_per_day, "m10_latency_per_hour": lambda log: _latency(m.latency_per_hour(log)),
    "m11_top_score_per_hour": lambda log: m.top_score_per_hour(log).withColumn("top_score", F.round("top_score", 6)),
}
RATED_PANELS = {"m3_recent_questions": m.recent_questions, "m12_rated_answers": m.rated_answers}

RANGED_NAMES = {"m2_outcomes_per_day": "m2_outcomes_in_range"}


def in_stored_range(t: Tables):
    return m.in_range(v.stored_log(t), *(F.lit(x).cast("timestamp_ntz") for x in RANGE))


def _ranged(name: str) -> None:
    inside = f"{v.SQL['messages_v']} WHERE ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"

    @query(RANGED_NAMES.get(name, f"{name}_in_range"), QUERIES[name].sql.replace(v.SQL["messages_v"], inside))
    def run(t: Tables):
        return PANELS[name](in_stored_range(t)) if name in PANELS else RATED_PANELS[name](in_stored_range(t), v.feedback(t))


for _name in (*PANELS, *RATED_PANELS):
    _ranged(_name)


@query("m13_feedback_upsert", v.with_views("rated_v", body="SELECT message_id, rating, given_at FROM rated_v"))
def m13(t: Tables):
    return m.feedback_upsert(v.feedback(t))


@query("m14_daily_count", v.with_views("messages_v", body="""
SELECT id, asked_at, CAST(n AS BIGINT) AS day_count, n >= 200 AS day_capped FROM (SELECT id, asked_at,
  count(*) OVER (PARTITION BY CAST(asked_at AS DATE) ORDER BY asked_at
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS n FROM messages_v)"""))
def m14(t: Tables):
    return m.daily_count(v.messages(t))


@query("m15_burst_count", v.with_views("messages_v", body="""
SELECT id, asked_at, CAST(n AS BIGINT) AS minute_count, n >= 10 AS minute_capped FROM (SELECT id, asked_at,
  count(*) OVER (ORDER BY asked_at RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) - 1 AS n
  FROM messages_v)"""))
def m15(t: Tables):
    return m.burst_count(v.messages(t))
