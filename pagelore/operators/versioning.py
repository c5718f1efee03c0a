"""Versioned page history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.functions import text
from pagelore.session import materialize


def with_row_hash(pages: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the change key (V2). Volatile columns must stay out of ``cols``."""
    return pages.withColumn("row_hash", text.row_hash(*cols))


def read_current_pages(history: DataFrame) -> DataFrame:
    return history.where(F.col("valid_to").isNull())


def scd2_merge(history: DataFrame, incoming: DataFrame, at: Column,
               cols: Sequence[str], key: str = "url") -> DataFrame:
    """Merge one complete load into the history (V3).

    Open versions absent from the load are closed at ``at``; rows whose
    ``(key, row_hash)`` is not open become new versions; the rest is untouched.

    Both decisions are made on keys and hashes alone and written first. The planner
    then knows how large the change set is before it reads a page text, and texts
    stay where they are whenever that set is small enough to broadcast.
    """
    ident = [key, "row_hash"]
    fresh = with_row_hash(incoming, cols)
    still_open = history.where(F.col("valid_to").isNull())
    open_keys = still_open.select(*ident)
    load_keys = fresh.select(*ident)

    closing = materialize(open_keys.join(load_keys, ident, "left_anti").withColumn("closed_at", at), "closing")
    opening = materialize(load_keys.join(open_keys, ident, "left_anti"), "opening")

    # Closed versions are final and pass by without a join.
    kept = history.where(F.col("valid_to").isNotNull()).unionByName(
        still_open.join(closing, ident, "left").withColumn("valid_to", F.col("closed_at")).select(*history.columns))
    added = fresh.join(opening, ident, "left_semi").withColumns(
        {"valid_from": at, "valid_to": F.lit(None).cast(history.schema["valid_to"].dataType)}
    )
    return evolve_union(kept, added)


def first_load(incoming: DataFrame, at: Column, cols: Sequence[str]) -> DataFrame:
    """History after a first load: every page is one open version."""
    return with_row_hash(incoming, cols).withColumns(
        {"valid_from": at, "valid_to": F.lit(None).cast("timestamp_ntz")})


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The corpus as it stood at ``at`` (V4)."""
    return history.where(
        (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def changes_between(history: DataFrame, start: Column, end: Column, key: str = "url") -> DataFrame:
    """Pages added, modified or retired between two moments (V5)."""
    def side(at: Column, name: str) -> DataFrame:
        return as_of(history, at).select(
            key, F.col("section").alias(f"{name}_section"), F.col("row_hash").alias(f"{name}_hash"))

    both = side(start, "old").join(side(end, "new"), key, "full_outer")
    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "retired")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return both.select(
        key, F.coalesce("new_section", "old_section").alias("section"), kind.alias("change")
    ).where(F.col("change").isNotNull())


def drift_by_section(changes: DataFrame) -> DataFrame:
    return changes.groupBy("section", "change").agg(F.count(F.lit(1)).alias("pages"))


def drift_by_day(history: DataFrame) -> DataFrame:
    """Versions opened and closed per day and section: the drift chart."""
    moved = history.select(
        "section",
        F.explode(F.array(
            F.struct(F.col("valid_from").alias("at"), F.lit("opened").alias("change")),
            F.struct(F.col("valid_to").alias("at"), F.lit("closed").alias("change")),
        )).alias("e"),
    ).where(F.col("e.at").isNotNull())
    return moved.groupBy(
        F.to_date("e.at").alias("day"), "section", F.col("e.change").alias("change")
    ).agg(F.count(F.lit(1)).alias("versions"))


def fetch_outcome(requested: Column, final: Column, status: Column) -> Column:
    """``ok``, ``gone``, ``offsite`` or ``abort`` for one fetch (V6)."""
    return (
        F.when(text.offsite_redirect(requested, final), "offsite")
        .when(status == 404, "gone")
        .when((status >= 200) & (status < 400), "ok")
        .otherwise("abort")
    )


def fetched_pages(fetches: DataFrame) -> DataFrame:
    """Rows to load. Gone and off-site pages drop out and are retired by the
    merge; any other failure stops the job, because loading a part of the corpus
    would retire every page that was not reached."""
    outcome = fetch_outcome(F.col("url"), F.col("final_url"), F.col("status"))
    stop = F.raise_error(F.concat(F.lit("fetch failed, load aborted: "), F.col("url")))
    keep = F.when(outcome == "abort", stop.cast("boolean")).otherwise(outcome == "ok")
    return fetches.where(keep)


def guidance_row(guidance: DataFrame, index_url: str, description: str) -> DataFrame:
    """One synthetic page per index document with guidance text (V7)."""
    return guidance.where(F.col("guidance") != "").select(
        F.concat(F.lit(index_url), F.lit("#guidance-"), F.col("doc_id")).alias("url"),
        F.lit(fx.GUIDANCE_SECTION).alias("section"),
        F.lit(fx.GUIDANCE_PREFIX).alias("title"),
        F.lit(description).alias("description"),
        F.lit("llm_guidance").alias("page_type"),
        F.col("guidance").alias("content"),
        text.content_hash(F.col("guidance")).alias("content_hash"),
    )


def evolve_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stack two loads whose columns may differ; missing ones become NULL."""
    return old.unionByName(new, allowMissingColumns=True)
