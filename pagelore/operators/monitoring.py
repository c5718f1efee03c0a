"""Dashboard aggregates over the message log.

Counts aggregate on the map side first, so a hot hour or day is one row per task
by the time it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore import fixed_values as fx


def in_range(log: DataFrame, start: Column | None = None, end: Column | None = None,
             at: str = "asked_at", day: str = "asked_on") -> DataFrame:
    """The dashboard's time filter, bounds included.

    A stored log is partitioned by ``day``: the same bounds on it leave the folders of
    other days unread. Bounds must be literals or foldable for that."""
    by_day = day in log.columns
    if start is not None:
        log = log.where(F.col(at) >= start)
        log = log.where(F.col(day) >= F.to_date(start)) if by_day else log
    if end is not None:
        log = log.where(F.col(at) <= end)
        log = log.where(F.col(day) <= F.to_date(end)) if by_day else log
    return log


def last_days(log: DataFrame, days: int = 7, at: str = "asked_at") -> DataFrame:
    return in_range(log, F.current_timestamp() - F.make_dt_interval(F.lit(days)), None, at)


def bucket(unit: str, at: Column) -> Column:
    return F.date_trunc(unit, at).cast("timestamp_ntz")


def fill_gaps(counts: DataFrame, unit: str, value: str, *series: str) -> DataFrame:
    """Empty buckets between the first and the last become 0, per series.

    Works on the aggregated rows: one row per bucket and series."""
    step = {"hour": F.expr("INTERVAL 1 HOUR"), "day": F.expr("INTERVAL 1 DAY")}[unit]
    # A chart shows a handful of series (routes, offered or not): one small set.
    ends = counts.agg(
        F.min("time").alias("a"), F.max("time").alias("b"),
        F.collect_set(F.struct(F.lit(0).alias("none"), *series)).alias("series"),
    ).where(F.col("a").isNotNull())
    spine = ends.select(F.explode(F.sequence("a", "b", step)).alias("time"), "series").select(
        "time", F.explode("series").alias("s")).select("time", *[F.col(f"s.{c}").alias(c) for c in series])
    filled = spine.join(counts, ["time", *series], "left")
    return filled.select("time", *series, F.coalesce(value, F.lit(0)).alias(value))


def questions_per_hour(log: DataFrame) -> DataFrame:
    counts = log.groupBy(bucket("hour", F.col("asked_at")).alias("time")).agg(
        F.count(F.lit(1)).alias("questions"))
    return fill_gaps(counts, "hour", "questions")


def outcome(route: Column) -> Column:
    return (F.when(route == "docs", "Answered").when(route == "refused", "Refused")
            .when(route == "error", "Failed").otherwise(route))


def _per_day(log: DataFrame, metric: Column, fill: bool) -> DataFrame:
    counts = log.groupBy(
        bucket("day", F.col("asked_at")).alias("time"), metric.alias("metric")
    ).agg(F.count(F.lit(1)).alias("value"))
    return fill_gaps(counts, "day", "value", "metric") if fill else counts


def outcomes_per_day(log: DataFrame) -> DataFrame:
    return _per_day(log, outcome(F.col("route")), True)


def _ratings_of(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Current ratings of a few messages (at most one table's page of rows)."""
    ids = F.broadcast(messages.select(F.col("id").alias("message_id")))
    return feedback_upsert(feedback.join(ids, "message_id", "left_semi"))


def recent_questions(log: DataFrame, feedback: DataFrame, n: int = 25) -> DataFrame:
    """Latest questions with their rating (M3). There is one rating per message,
    so the limit comes before the join and feedback is filtered by ``n`` ids."""
    last = log.orderBy(F.col("asked_at").desc(), F.col("id").desc()).limit(n)
    rated = _ratings_of(last, feedback)
    return last.join(rated, last["id"] == rated["message_id"], "left").select(
        F.col("asked_at").alias("asked"), F.left("question", F.lit(70)).alias("question"), "route",
        F.coalesce("provider", F.lit("")).alias("provider"),
        F.coalesce("model", F.lit("")).alias("model"),
        (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"),
        F.when(F.col("cached"), "cache").otherwise("").alias("from"),
        F.col("latency_ms").alias("ms"),
        F.coalesce(F.col("rating").cast("string"), F.lit("")).alias("rating"),
    )


def demo_share(log: DataFrame) -> DataFrame:
    """Share of answers offering a demonstration, in percent (M4)."""
    offered = F.count_if(F.col("sandbox_flow").isNotNull())
    return log.where(F.col("route") == "docs").agg(
        F.round(100.0 * offered / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("value"))


def demo_vs_answer_only(log: DataFrame) -> DataFrame:
    metric = F.when(F.col("sandbox_flow").isNotNull(), "Runnable demo offered").otherwise("Answer only")
    return _per_day(log.where(F.col("route") == "docs"), metric, True)


def flow_demand(log: DataFrame) -> DataFrame:
    return log.where(F.col("sandbox_flow").isNotNull()).groupBy(
        F.col("sandbox_flow").alias("flow")
    ).agg(F.count(F.lit(1)).alias("times_offered")).orderBy(F.col("times_offered").desc(), "flow")


def _usage(field: str, kind: str = "string") -> Column:
    value = F.get_json_object("router", f"$.usage.{field}")
    return value if kind == "string" else value.try_cast(kind)


def api_calls_per_day(log: DataFrame) -> DataFrame:
    """Uncached model calls by model and type (M7): two calls make one question.
    Both kinds come out of one scan."""
    answer = F.when(
        F.col("model").isNotNull() & ~F.coalesce("cached", F.lit(False)),
        F.concat(F.col("model"), F.lit(" · answer")))
    routing = F.when(
        _usage("model").isNotNull() & ~F.coalesce(_usage("cached", "boolean"), F.lit(False)),
        F.concat(_usage("model"), F.lit(" · routing")))
    calls = log.select("asked_at", F.explode(F.array_compact(F.array(answer, routing))).alias("metric"))
    return _per_day(calls, F.col("metric"), False)


def token_spend_per_day(log: DataFrame) -> DataFrame:
    def billed(field: str) -> Column:
        answer = F.when(F.coalesce("cached", F.lit(False)), 0).otherwise(F.coalesce(field, F.lit(0)))
        router = F.when(F.coalesce(_usage("cached", "boolean"), F.lit(False)), 0).otherwise(
            F.coalesce(_usage(field, "int"), F.lit(0)))
        return F.sum((answer + router).cast("long")).alias(field)

    return log.groupBy(bucket("day", F.col("asked_at")).alias("time")).agg(
        billed("prompt_tokens"), billed("completion_tokens"))


def provider_per_day(log: DataFrame) -> DataFrame:
    return _per_day(log.where(F.col("provider").isNotNull()), F.col("provider"), False)


def latency_per_hour(log: DataFrame, count_errors: bool = True, approximate: bool = False) -> DataFrame:
    """Mean and p95 latency (M10). Error rows carry a latency of 0 and count
    unless told otherwise.

    Rows collapse to (hour, latency) counts first, so an hour's percentile sees
    its distinct latencies, not its rows."""
    rows = log.where(F.col("latency_ms").isNotNull())
    if not count_errors:
        rows = rows.where(F.col("route") != "error")
    counted = rows.groupBy(
        bucket("hour", F.col("asked_at")).alias("time"), "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum(F.col("latency_ms").cast("double") * F.col("n")) / F.sum("n")
    if approximate:
        p95 = rows.groupBy(bucket("hour", F.col("asked_at")).alias("time")).agg(
            F.percentile_approx("latency_ms", 0.95).cast("double").alias("p95_ms"))
        return counted.groupBy("time").agg(mean.alias("avg_ms")).join(p95, "time")
    return counted.groupBy("time").agg(
        mean.alias("avg_ms"), F.percentile("latency_ms", 0.95, F.col("n")).alias("p95_ms"))


def top_score_per_hour(log: DataFrame) -> DataFrame:
    """Mean score of the first retrieved chunk."""
    found = F.from_json("retrieved_chunks", "array<struct<score:double>>")
    return log.where(F.size(found) > 0).groupBy(
        bucket("hour", F.col("asked_at")).alias("time")
    ).agg(F.avg(found[0]["score"]).alias("top_score"))


def feedback_upsert(feedback: DataFrame) -> DataFrame:
    """One rating per message, the last write wins; other ratings are rejected."""
    order = F.struct("given_at", *(["seq"] if "seq" in feedback.columns else []))
    last = feedback.where(F.col("rating").isin(-1, 1)).groupBy("message_id").agg(
        F.max_by(F.struct("rating", "given_at"), order).alias("f"))
    return last.select("message_id", "f.rating", "f.given_at")


def rated_answers(log: DataFrame, feedback: DataFrame, n: int = 25) -> DataFrame:
    """Rated answers, worst first, then newest."""
    rated = feedback_upsert(feedback).select("message_id", "rating")
    rows = log.select("id", "asked_at", "question", "model", "latency_ms").join(
        rated, F.col("id") == F.col("message_id"))
    top = rows.orderBy("rating", F.col("asked_at").desc(), F.col("id").desc()).limit(n)
    return top.select(
        F.col("asked_at").alias("asked"),
        F.when(F.col("rating") == 1, "👍 good").otherwise("👎 bad").alias("verdict"),
        F.left("question", F.lit(70)).alias("question"),
        F.coalesce("model", F.lit("")).alias("model"), F.col("latency_ms").alias("ms"),
    )


# --- Load counters ----------------------------------------------------------
#
# "How many messages up to now" is a running count over one global clock. A
# window over a day would put a hot day into one task, so the count is the sum of
# two bounded parts: all earlier seconds of the day (86,400 rows at most) and the
# distinct moments within the second.

def _counts_upto(moments: DataFrame) -> DataFrame:
    """Adds ``upto``, the messages of the day at or before ``at``, and ``day_total``."""
    keyed = moments.withColumns({"second": F.date_trunc("second", "at"), "day": F.to_date("at")})
    per_second = keyed.groupBy("day", "second").agg(F.sum("own").alias("n"))
    of_day = W.partitionBy("day")
    earlier = F.coalesce(
        F.sum("n").over(of_day.orderBy("second").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = per_second.select(
        "second", earlier.alias("base"), F.sum("n").over(of_day).alias("day_total"))
    inside = F.sum("own").over(
        W.partitionBy("second").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    return keyed.withColumn("inside", inside).join(base, "second").withColumn(
        "upto", F.col("base") + F.col("inside"))


def load_counters(log: DataFrame, limit_day: int = fx.MAX_QUESTIONS_PER_DAY,
                  limit_minute: int = fx.MAX_QUESTIONS_PER_MINUTE) -> DataFrame:
    """For each message, the earlier messages of its day (M14) and of the minute
    before it (M15), with the caps they would hit. Messages of the same moment
    count for each other."""
    per_moment = log.groupBy(F.col("asked_at").alias("ts")).agg(F.count(F.lit(1)).alias("own"))
    # Each moment also asks for the count just before the minute that ends with it.
    just_before = F.col("ts") - F.expr("INTERVAL '60.000001' SECOND")
    moments = per_moment.select("ts", F.explode(F.array(
        F.struct(F.col("ts").alias("at"), F.col("own").alias("own"), F.lit(False).alias("probe")),
        F.struct(just_before.alias("at"), F.lit(0).cast("long").alias("own"), F.lit(True).alias("probe")),
    )).alias("m")).select("ts", "m.*")
    counts = _counts_upto(moments)

    def of(probe: bool, value: str) -> Column:
        return F.max(F.when(F.col("probe") == probe, F.col(value)))

    carried = F.when(of(False, "day") == of(True, "day"), 0).otherwise(of(True, "day_total"))
    per_ts = counts.groupBy("ts").agg(
        (of(False, "upto") - 1).alias("day_count"),
        (of(False, "upto") + carried - of(True, "upto") - 1).alias("minute_count"))
    return log.join(per_ts.withColumnRenamed("ts", "asked_at"), "asked_at").select(
        "id", "asked_at", "day_count", (F.col("day_count") >= limit_day).alias("day_capped"),
        "minute_count", (F.col("minute_count") >= limit_minute).alias("minute_capped"))


def daily_count(log: DataFrame, limit: int = fx.MAX_QUESTIONS_PER_DAY) -> DataFrame:
    """M14 alone: nobody asks for the counts of a minute ago."""
    moments = log.groupBy(F.col("asked_at").alias("at")).agg(F.count(F.lit(1)).alias("own"))
    counts = _counts_upto(moments).select(F.col("at").alias("asked_at"), (F.col("upto") - 1).alias("day_count"))
    return log.join(counts, "asked_at").select("id", "asked_at", "day_count", (F.col("day_count") >= limit).alias("day_capped"))


def burst_count(log: DataFrame, limit: int = fx.MAX_QUESTIONS_PER_MINUTE) -> DataFrame:
    return load_counters(log, limit_minute=limit).select("id", "asked_at", "minute_count", "minute_capped")
