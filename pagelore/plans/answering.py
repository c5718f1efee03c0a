"""The whole batch: route, retrieve, merge, write context, answer (Q14)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.functions import text
from pagelore.operators import fusion, qa, vectors
from pagelore.plans.search import Corpus, SearchConfig, label_of, ranked_ids
from pagelore.session import materialize


@dataclass(frozen=True)
class Prompts:
    """The system prompts, and every fixed text a user or a model gets to see."""

    router: str
    answer: str
    refusal: str = "Nothing relevant was found in the documentation."
    out_of_scope: str = "This question is outside the documentation."
    not_asked: str = "The question is missing or too long."
    failure: str = fx.ERROR_TEXT
    excerpts: str = fx.EXCERPTS_HEAD
    question: str = fx.QUESTION_HEAD
    skipped: tuple[str, str] = (fx.SKIPPED_HEAD, fx.SKIPPED_TAIL)


def _requests(rows: DataFrame, system: str) -> DataFrame:
    return rows.withColumns({
        "system": F.lit(system), "temperature": F.lit(0.0), "model": F.lit(None).cast("string")})


def _part_hits(parts: DataFrame, corpus: Corpus, cfg: SearchConfig, encoder) -> DataFrame:
    """``qid, part, chunk_id, score, rank``; a question in several parts reads
    fewer hits for each."""
    encoded = vectors.encode_batches(
        parts.select("part_id", "query", F.lit(None).cast("string").alias("none")),
        encoder, "none", "none", "query")
    queries = materialize(encoded.select(
        F.col("part_id").alias("qid"), "query", F.col("embedding").alias("qvec")), "queries")

    def run(some: DataFrame, depth: int) -> DataFrame:
        return ranked_ids(some, corpus, replace(cfg, top_k=depth))

    info = parts.select("part_id", "qid", "part", "n_parts")
    limit = F.when(F.col("n_parts") > 1, fx.PER_SUB_TOP_K).otherwise(cfg.top_k)
    if cfg.rerank:   # a re-ranking pool depends on the depth asked for
        one = info.where(F.col("n_parts") == 1).select(F.col("part_id").alias("qid"))
        many = info.where(F.col("n_parts") > 1).select(F.col("part_id").alias("qid"))
        hits = run(queries.join(one, "qid", "left_semi"), cfg.top_k).unionByName(
            run(queries.join(many, "qid", "left_semi"), fx.PER_SUB_TOP_K))
    else:
        hits = run(queries, max(cfg.top_k, fx.PER_SUB_TOP_K))
    return hits.withColumnRenamed("qid", "part_id").join(info, "part_id").where(
        F.col("rank") <= limit).select("qid", "part", "chunk_id", "score", "rank")


def _routed(asked: DataFrame, prompts: Prompts, cache: DataFrame, generator) -> tuple[DataFrame, DataFrame]:
    """Questions with their router's verdict and ``router``, the JSON text that is logged;
    and the new cache rows."""
    calls, fresh = qa.cached_generate(
        _requests(asked.withColumn("user", F.col("question")), prompts.router), cache, generator)
    usage = F.struct("provider", F.col("served_model").alias("model"), "prompt_tokens", "completion_tokens", "cached")
    replies = calls.select("qid", "question", F.col("text").alias("raw"), usage.alias("usage"), F.col("error").alias("call_error"))
    routed = qa.validate_flow_choice(
        qa.parse_route(replies), [key for key, _ in fx.FLOW_PATTERNS]).drop("raw")
    routed = routed.withColumn("route_error", F.coalesce("call_error", "route_error"))
    verdict = F.struct("in_scope", "sub_questions", "reason", "sandbox_flow", F.col("route_error").alias("error"), "usage")
    return routed.withColumn("router", F.to_json(verdict)).drop("usage", "call_error"), fresh


def answer_batch(questions: DataFrame, corpus: Corpus, cfg: SearchConfig, prompts: Prompts,
                 cache: DataFrame, generator: Callable[[], qa.Generator],
                 encoder: Callable[[], vectors.Encoder], cache_path: str | None = None) -> DataFrame:
    """Answer ``qid, question`` rows. One row per question: ``qid, question, answer,
    route, retrieved, provider, model, prompt_tokens, completion_tokens, cached,
    error, sandbox_flow, sandbox_params, router, retrieval_config, latency_ms``.

    Failures are values: a missing or overlong question is refused with its reason in
    ``error``, a failed routing call fails open, a failed answer has route ``error`` and
    latency 0; other rows have none, as calls are made in batches. New replies are
    appended to ``cache_path``, so the next batch pays for none of them twice. Each stage
    that several others read is written once.
    """
    given = questions.select(F.col("qid").cast("long"), "question").withColumn(
        "not_asked", qa.refusal_reason(F.col("question")))
    asked = qa.prepare_questions(given.where("not_asked is null").drop("not_asked"))
    routed, routing_cache = _routed(asked, prompts, cache, generator)
    routed = materialize(routed, "routed")
    wanted, refused = qa.gate_scope(routed)

    parts = wanted.select(
        "qid", F.size("sub_questions").alias("n_parts"), F.posexplode("sub_questions").alias("part", "query")
    ).withColumn("part_id", F.col("qid") * fx.MAX_SUB_QUESTIONS + F.col("part"))
    part_hits = materialize(_part_hits(parts, corpus, cfg, encoder), "part_hits")
    merged = fusion.merge_parts(part_hits, cfg.top_k)
    scores = part_hits.groupBy("qid", "chunk_id").agg(
        F.min_by("score", F.struct("rank", "part")).alias("score"))
    hits = materialize(
        merged.join(scores, ["qid", "chunk_id"]).join(
            corpus.chunks.select("chunk_id", "page_url", "page_title", "heading_path", "content"), "chunk_id"),
        "hits")
    skipped = fusion.skipped_parts(parts, part_hits).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("part", "query"))).alias("skipped"))
    retrieved = hits.groupBy("qid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "page_url", "score"))),
        lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["page_url"].alias("page_url"),
                           h["score"].alias("score"))).alias("retrieved"))

    ready = wanted.join(qa.context_block(hits), "qid")
    user = F.concat(F.lit(prompts.excerpts), F.col("context"), F.lit(prompts.question),
                    qa.question_block(F.col("question"), F.col("sub_questions")))
    made, answer_cache = qa.cached_generate(
        _requests(ready.select("qid", user.alias("user")), prompts.answer), cache, generator)
    made = made.select("qid", "text", "provider", F.col("served_model").alias("model"),
                       "prompt_tokens", "completion_tokens", "cached", "error")
    if cache_path:
        routing_cache.unionByName(answer_cache).write.mode("append").parquet(cache_path)

    rows = wanted.join(made, "qid", "left").join(retrieved, "qid", "left").join(skipped, "qid", "left")
    route = F.when(F.col("error").isNotNull(), "error").when(F.col("text").isNull(), "refused").otherwise("docs")
    head, tail = prompts.skipped
    note = F.when(F.col("skipped").isNotNull(), F.concat(
        F.lit(head), F.array_join(F.transform("skipped", lambda s: s["query"]), "; "), F.lit(tail))).otherwise("")
    body = (F.when(route == "error", prompts.failure).when(route == "refused", prompts.refusal)
            .otherwise(F.concat("text", note)))
    answered = rows.select(
        "qid", "question", text.retitle_without_code(body).alias("answer"), route.alias("route"),
        # A failed answer logs no hits.
        F.when(route == "docs", F.col("retrieved")).alias("retrieved"),
        "provider", "model", "prompt_tokens", "completion_tokens", "cached", "error",
        "sandbox_flow", "sandbox_params", "route_error", "router")
    turned_away = refused.select(
        "qid", "question", F.lit(prompts.out_of_scope).alias("answer"), F.lit("refused").alias("route"),
        "sandbox_flow", "sandbox_params", "route_error", "router")
    not_asked = given.where("not_asked is not null").select(
        "qid", text.redact_secrets(F.col("question")).alias("question"), F.lit(prompts.not_asked).alias("answer"),
        F.lit("refused").alias("route"), F.col("not_asked").alias("error"))
    out = answered.unionByName(turned_away, allowMissingColumns=True).unionByName(not_asked, allowMissingColumns=True)
    flow = qa.choose_flow(F.col("route"), F.col("answer"), F.col("sandbox_flow"),
                          F.col("route_error"), F.col("question"))
    return out.withColumns({
        "sandbox_flow": flow, "retrieval_config": F.concat(label_of(cfg), F.lit(f"@{cfg.top_k}")),
        "latency_ms": F.when(F.col("route") == "error", F.lit(0)),
    }).drop("route_error")
