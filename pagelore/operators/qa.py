"""Batch question answering steps (Q1-Q19), each a DataFrame function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore import fixed_values as fx
from pagelore.functions import json_values as jv
from pagelore.functions import text
from pagelore.schemas import COMPLETION_CACHE
from pagelore.session import materialize

FAIL_OPEN = "router error, fail-open"


def prepare_questions(questions: DataFrame, question: str = "question",
                      cap: int = fx.MAX_QUESTION_CHARS) -> DataFrame:
    """Drop questions over the length cap (Q2), redact the rest (Q1)."""
    return questions.where(F.length(question) <= cap).withColumn(
        question, text.redact_secrets(F.col(question)))


def refusal_reason(question: Column, cap: int = fx.MAX_QUESTION_CHARS) -> Column:
    """Why a question is not asked at all, NULL if it is: missing, or over the length cap."""
    return F.when(question.isNull(), "no question").when(F.length(question) > cap, "question too long")


def read_replies(replies: DataFrame, raw: str = "raw", to: str = "reply") -> DataFrame:
    """``replies`` with the object each holds as VARIANT in ``to``, NULL where there is none.

    :func:`parse_route` makes that column and :func:`validate_flow_choice` reads it too, so a
    reply is parsed once. Only text between braces can be an object; other text is not parsed."""
    return replies.withColumn(to, jv.parsed(F.nullif(text.brace_span(F.col(raw)), F.lit(""))))


def parse_route(replies: DataFrame, question: str = "question", raw: str = "raw", reply: str = "reply") -> DataFrame:
    """Router replies -> ``reply, in_scope, sub_questions, reason, route_error`` (Q3).

    A reply that is no JSON object, or whose parts cannot be listed, fails open:
    the question goes through as it is, with the error kept.
    """
    found = F.col(reply)
    # A member's JSON text tells its kind and its truth; every step below reads it once.
    rows = (replies if reply in replies.columns else read_replies(replies, raw, reply)).withColumns({
        "__subs": jv.member(found, "$.sub_questions"), "__in": jv.member(found, "$.in_scope"),
        "__reason": jv.member(found, "$.reason")})
    rows = rows.withColumns({"__subs_text": F.to_json("__subs"), "__in_text": F.to_json("__in"),
                             "__reason_text": F.to_json("__reason")})
    kind = jv.kind_of_text(F.col("__subs_text"))
    listed = F.transform(
        F.filter(F.try_variant_get("__subs", "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
        lambda x: x.cast("string"))
    parts = (
        F.when(F.col("__subs_text").isNull() | F.col("__subs_text").isin("[]", "{}", '""'), F.array().cast("array<string>"))
        .when(kind == "ARRAY", listed)
        .when(kind == "STRING", F.split(F.try_variant_get("__subs", "$", "string"), ""))
        .when(kind == "OBJECT", F.map_keys(F.try_variant_get("__subs", "$", "map<string,variant>")))
    )
    rows = rows.withColumn("__parts", parts)
    failed = found.isNull() | F.col("__parts").isNull()
    rows = rows.withColumns({
        "__failed": failed,
        "__clean": F.slice(F.filter(F.transform("__parts", text.strip), lambda s: s != ""), 1, fx.MAX_SUB_QUESTIONS),
        "__true": jv.truthy_text(F.col("__in_text"))})
    reason = (
        F.when(F.col("__reason_text").isNull(), "")
        .when(F.col("__reason_text") == "null", "None")
        .otherwise(F.col("__reason").cast("string")))
    own = F.array(F.col(question))
    return rows.withColumns({
        "in_scope": F.col("__failed") | F.col("__true"),
        "sub_questions": F.when(
            F.col("__failed") | (F.col("__true") & (F.size("__clean") == 0)), own).otherwise(F.col("__clean")),
        "reason": F.when(F.col("__failed"), FAIL_OPEN).otherwise(reason),
        "route_error": F.when(F.col("__failed"), "unreadable router reply"),
    }).drop("__subs", "__in", "__reason", "__subs_text", "__in_text", "__reason_text", "__parts", "__failed",
            "__clean", "__true")


def gate_scope(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in scope, refused): refused questions never reach retrieval (Q4)."""
    return routed.where("in_scope"), routed.where(~F.col("in_scope"))


def validate_flow_choice(routed: DataFrame, keys: Sequence[str], reply: str = "reply") -> DataFrame:
    """Keep the router's flow only if it is on the list and the question is in
    scope; keep its parameters only if they are an object (Q5). Uses up ``reply``."""
    rows = routed.withColumns({"__flow": jv.member(F.col(reply), "$.sandbox_flow"),
                               "__params": jv.member(F.col(reply), "$.sandbox_params")})
    rows = rows.withColumns({"__flow_text": F.to_json("__flow"), "__params_text": F.to_json("__params")})
    name = F.col("__flow").cast("string")
    valid = (jv.kind_of_text(F.col("__flow_text")) == "STRING") & name.isin(list(keys)) & F.col("in_scope")
    if "route_error" in routed.columns:
        valid = valid & F.col("route_error").isNull()
    rows = rows.withColumn("sandbox_flow", F.when(valid, name))
    given = F.col("sandbox_flow").isNotNull() & (jv.kind_of_text(F.col("__params_text")) == "OBJECT")
    return rows.withColumn("sandbox_params", F.when(given, F.col("__params_text")).otherwise("{}")).drop(
        reply, "__flow", "__params", "__flow_text", "__params_text")


def flow_param_specs(spark) -> DataFrame:
    return spark.createDataFrame(
        [(f, n, k, d, lo, hi, list(c)) for f, n, k, d, lo, hi, c in fx.FLOW_PARAMS],
        "sandbox_flow string, name string, kind string, default string, minimum long, "
        "maximum long, choices array<string>")


def coerce_params(chosen: DataFrame, specs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per known parameter with a safe value (Q6): ``keep, sandbox_flow,
    name, value``. Unknown names drop out, bad values become the default, numbers
    are clamped. ``specs`` is the fixed table of :func:`flow_param_specs`."""
    given = F.from_json("sandbox_params", "map<string,variant>")
    rules = specs.groupBy("sandbox_flow").agg(F.collect_list(F.struct(*[
        c for c in specs.columns if c != "sandbox_flow"])).alias("rules"))
    # An outer join and explode: a condition on the flow would be moved to the scan, with all of the parsing in it.
    rows = chosen.select(*keep, "sandbox_flow", given.alias("given")).join(
        F.broadcast(rules), "sandbox_flow", "left").select(
        *keep, "sandbox_flow", "given", F.explode_outer("rules").alias("rule")).where("rule is not null").select(
        *keep, "sandbox_flow", "given", "rule.*")
    rows = rows.withColumn("raw", F.try_element_at("given", F.col("name")))
    number = jv.whole_number(F.col("raw"))
    # greatest and least skip NULLs, a missing number must stay missing
    clamped = F.when(number.isNotNull(), F.greatest(
        F.col("minimum").cast("double"), F.least(F.col("maximum").cast("double"), number)))
    as_text = F.col("raw").cast("string")
    picked = (jv.kind(F.col("raw")) == "STRING") & F.array_contains("choices", as_text)
    value = F.when(F.col("kind") == "choice", F.when(picked, as_text)).otherwise(
        clamped.cast("long").cast("string"))
    return rows.select(*keep, "sandbox_flow", "name", F.coalesce(value, "default").alias("value"))


def match_flow(question: Column, patterns: Sequence[tuple[str, str]] = fx.FLOW_PATTERNS) -> Column:
    """First matching pattern names the flow (Q7): one pass over the text."""
    ladder = None
    for key, pattern in patterns:
        hit = question.rlike(f"(?iu){pattern}")
        ladder = F.when(hit, key) if ladder is None else ladder.when(hit, key)
    return ladder


def choose_flow(route: Column, answer: Column, flow: Column, route_error: Column,
                question: Column) -> Column:
    """Flow to offer: only under an answer that shows code; the router's choice,
    or the pattern match where the router failed (Q8)."""
    chosen = F.when(flow.isNotNull() & (flow != ""), flow).when(
        route_error.isNotNull() & (route_error != ""), match_flow(question))
    return F.when((route == "docs") & text.has_code(answer), chosen)


# One request: the generator gets a frame with ``system, user`` and returns one
# dict per row with text, provider, model, prompt_tokens, completion_tokens, or
# an exception object for a call that failed.
Generator = Callable[[pd.DataFrame], list]

REQUEST_KEY = ("system", "user", "temperature", "model")
GENERATED = T.StructType(COMPLETION_CACHE.fields + [T.StructField("error", T.StringType())])


def with_cache_key(requests: DataFrame) -> DataFrame:
    return requests.withColumn("cache_key", text.row_hash(*REQUEST_KEY))


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests answered from the cache, one row per distinct missing request).

    An entry without text is damaged and counts as missing."""
    keyed = with_cache_key(requests)
    good = cache.where(F.col("text").isNotNull())
    hits = keyed.join(good.withColumnRenamed("model", "served_model"), "cache_key")
    misses = keyed.join(good.select("cache_key"), "cache_key", "left_anti")
    return hits, misses.select("cache_key", *REQUEST_KEY).dropDuplicates(["cache_key"])


def generate(misses: DataFrame, generator: Callable[[], Generator]) -> DataFrame:
    """Call the generator once per distinct request, in Arrow batches."""
    names = [f.name for f in COMPLETION_CACHE.fields[1:]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = generator()
        for frame in frames:
            rows = []
            for key, reply in zip(frame["cache_key"], call(frame)):
                if isinstance(reply, Exception):
                    rows.append([key] + [None] * len(names) + [str(reply) or type(reply).__name__])
                else:
                    rows.append([key] + [reply.get(n) for n in names] + [None])
            out = pd.DataFrame(rows, columns=["cache_key", *names, "error"])
            for n in ("prompt_tokens", "completion_tokens"):
                out[n] = out[n].astype("Int32")
            yield out

    return misses.mapInPandas(run, GENERATED)


def cached_generate(requests: DataFrame, cache: DataFrame,
                    generator: Callable[[], Generator]) -> tuple[DataFrame, DataFrame]:
    """Answer requests from the cache, else by one call per distinct request (Q9).

    Returns (every request with ``text, provider, served_model, prompt_tokens,
    completion_tokens, cached, error``, new cache rows). New replies are written
    to the shared folder first, so the calls run once whatever reads them.
    """
    hits, misses = split_cached(requests, cache)
    fresh = materialize(generate(misses, generator), "generated")
    answered = with_cache_key(requests).join(
        cache.where(F.col("text").isNotNull()).select("cache_key"), "cache_key", "left_anti"
    ).join(fresh.withColumnRenamed("model", "served_model"), "cache_key")
    out = hits.withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)}).unionByName(
        answered.withColumn("cached", F.lit(False)))
    new = fresh.where(F.col("error").isNull()).select(*[f.name for f in COMPLETION_CACHE.fields])
    return out, new


def total_tokens(prompt: Column, completion: Column) -> Column:
    """Sum of both counts, NULL only if neither is known (Q10)."""
    return F.when(prompt.isNotNull() | completion.isNotNull(),
                  F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def _numbered(hits: DataFrame, body: Column, name: str) -> DataFrame:
    # At most top_k hits per question.
    blocks = hits.select("qid", "rank", body.alias("body")).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("blocks"))
    return blocks.select(
        "qid", F.array_join(F.transform("blocks", lambda b: b["body"]), "\n\n---\n\n").alias(name))


def context_block(hits: DataFrame, cap: int = fx.MAX_EXCERPT_CHARS) -> DataFrame:
    """Numbered, citable excerpts per question (Q11): ``qid, context``."""
    header = F.concat(
        F.lit("["), F.col("rank"), F.lit("] "),
        F.coalesce(F.nullif("page_title", F.lit("")), "page_url"),
        F.when(F.coalesce("heading_path", F.lit("")) != "",
               F.concat(F.lit(" — "), F.col("heading_path"))).otherwise(""))
    content = F.when(
        F.length("content") > cap, F.concat(F.left("content", F.lit(cap)), F.lit(fx.EXCERPT_MARK))
    ).otherwise(F.col("content"))
    return _numbered(
        hits, F.concat(header, F.lit("\nSource: "), F.col("page_url"), F.lit("\n\n"), content), "context")


def judge_context(hits: DataFrame, cap: int = fx.JUDGE_EXCERPT_CHARS) -> DataFrame:
    """Excerpts as the judge sees them (Q12): ``qid, context``."""
    body = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("page_url"), F.lit("\n"),
                    F.left("content", F.lit(cap)))
    return _numbered(hits, body, "context")


def question_block(question: Column, parts: Column) -> Column:
    """The question, with its parts numbered when there are several (Q13)."""
    listed = F.array_join(
        F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    return F.when(F.size(parts) <= 1, question).otherwise(F.concat(
        question, F.lit("\n\nThis question has "), F.size(parts).cast("string"),
        F.lit(" parts:\n"), listed,
        F.lit("\n\nAnswer each part under its own markdown heading.")))


def group_citations(hits: DataFrame) -> DataFrame:
    """One row per cited page, with every [n] that points at it (Q16)."""
    heading = F.coalesce("heading_path", F.lit(""))
    grouped = hits.groupBy("qid", "page_url").agg(
        F.array_sort(F.collect_list("rank")).alias("indices"),
        F.min_by("page_title", "rank").alias("page_title"),
        F.min(heading).alias("low"), F.max(heading).alias("high"),
    )
    return grouped.select(
        "qid", "page_url", "page_title",
        F.array_join(F.transform("indices", lambda i: F.concat(F.lit("["), i, F.lit("]"))), "").alias("markers"),
        F.element_at("indices", 1).alias("first_index"),
        F.when(F.col("low") == F.col("high"), F.nullif("low", F.lit(""))).alias("heading"),
    )


#: Events of one id in one time bin that meet windows in one task.
HOT_EVENTS = 100_000
LINK_COLUMNS = ("object_id", "payment_intent", "subscription", "customer", "setup_intent")


def correlate_events(events: DataFrame, touched: DataFrame, lifecycle: Sequence[str] = fx.EVENT_LIFECYCLE,
                     bin_width: int = 3_600) -> DataFrame:
    """Events of a run: any of five ids was touched, within the run's window (Q18).

    ``events``: ``event_id, type, created`` and the five ids; ``touched``:
    ``run_id, ref_id, window_start`` and, if windows end, ``window_end`` (included; a run
    without an end then has no events). Adds ``step`` and ``lifecycle_pos``; order by
    ``run_id, created, lifecycle_pos, event_id`` to read a run.

    Windows with an end meet events by id and time bin, so what is joined is bounded by the
    windows and not by an id's whole past; a bin that holds more than ``HOT_EVENTS`` events of
    one id is cut into cells.
    """
    refs = events.select(
        "event_id", "type", "created",
        F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in LINK_COLUMNS]))).alias("ref_id"),
    ).where(F.col("ref_id").isNotNull())
    if "window_end" in touched.columns:
        mine = _within_windows(refs, touched, bin_width)
    else:
        mine = refs.join(touched, "ref_id").where(F.col("created") >= F.col("window_start"))
    once = mine.groupBy("run_id", "event_id").agg(
        F.first("type").alias("type"), F.first("created").alias("created"))
    steps = F.array(*[F.lit(t) for t in lifecycle])
    found = F.array_position(steps, F.col("type"))
    place = F.when(found > 0, found - 1).otherwise(F.lit(len(lifecycle)).cast("long"))
    return once.withColumn("lifecycle_pos", place)


def _within_windows(refs: DataFrame, touched: DataFrame, bin_width: int) -> DataFrame:
    bins = [F.floor(F.col(c) / bin_width).cast("long") for c in ("window_start", "window_end")]
    asked = touched.where(F.col("window_start") <= F.col("window_end")).withColumn("bin", F.explode(F.sequence(*bins)))
    placed = refs.withColumn("bin", F.floor(F.col("created") / bin_width).cast("long"))
    cells = F.ceil(F.count(F.lit(1)) / HOT_EVENTS).alias("cells")
    hot = materialize(placed.groupBy("ref_id", "bin").agg(cells).where("cells > 1"), "cells")
    key = ["ref_id", "bin", "cell"]
    n = F.coalesce("cells", F.lit(1))
    placed = placed.join(hot, key[:2], "left").withColumn("cell", F.pmod(F.xxhash64("event_id"), n)).drop("cells")
    asked = asked.join(hot, key[:2], "left").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("cells")
    return placed.join(asked, key).where(F.col("created").between(F.col("window_start"), F.col("window_end")))


def drop_null_fields(value: Column) -> Column:
    """JSON text of a struct without its NULL fields; NULLs inside lists stay (Q19)."""
    return F.to_json(value, {"ignoreNullFields": "true"})
