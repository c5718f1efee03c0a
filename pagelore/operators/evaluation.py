"""Retrieval and answer evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.functions import json_values as jv
from pagelore.functions import text
from pagelore.plans.search import SearchConfig


def build_ground_truth(candidates: DataFrame, mapping: DataFrame, written: DataFrame,
                       root: str = "") -> DataFrame:
    """Mapped candidates plus written questions, in the question schema (G1).

    ``candidates``: ``lineno, question, source_url``; ``mapping``: ``lineno, path``;
    ``written``: ``question, path``.
    """
    mapped = candidates.join(mapping, "lineno").select(
        "question", F.lit("harvested").alias("source"), "source_url",
        F.concat(F.lit(root), F.col("path")).alias("answer_page_url"))
    own = written.select(
        "question", F.lit("synthetic").alias("source"), F.lit(None).cast("string").alias("source_url"),
        F.concat(F.lit(root), F.col("path")).alias("answer_page_url"))
    return mapped.unionByName(own)


def missing_answers(questions: DataFrame, corpus_urls: DataFrame) -> DataFrame:
    """Questions whose answer page is outside the corpus."""
    return questions.join(
        corpus_urls.select(F.col("url").alias("answer_page_url")).distinct(), "answer_page_url", "left_anti")


def require_answers(questions: DataFrame, corpus_urls: DataFrame, shown: int = 20) -> DataFrame:
    bad = missing_answers(questions, corpus_urls).select("answer_page_url").distinct().limit(shown)
    urls = [r[0] for r in bad.collect()]
    if urls:
        raise ValueError(f"answer pages not in corpus (first {shown}): {urls}")
    return questions


def count_by_source(questions: DataFrame) -> DataFrame:
    return questions.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def config_grid(top_k: Sequence[int] = fx.TOP_K_VALUES) -> list[SearchConfig]:
    """Every configuration of the sweep."""
    def of(mode: str, match: str, k: int, rerank: bool) -> SearchConfig:
        return SearchConfig(None if mode == "vector" else match, mode != "keyword", k, rerank)

    return [of(mode, match, k, False) for mode, match in fx.MODE_VARIANTS for k in top_k] + [
        of(mode, "all", k, True) for mode in fx.RERANKED_MODES for k in top_k]


def config_rows(configs: Sequence[SearchConfig]) -> Column:
    """The grid as an array literal, to fan questions out with ``explode``."""
    return F.array(*[
        F.struct(
            F.lit(i).alias("config_id"), F.lit(c.mode).alias("mode"), F.lit(c.top_k).alias("top_k"),
            F.lit(c.terms or "all").alias("keyword_match"), F.lit(c.damping).alias("rrf_k"),
            F.lit(c.rerank).alias("rerank"), F.lit(False).alias("query_rewrite"),
        ) for i, c in enumerate(configs)])


def fan_out(questions: DataFrame, configs: Sequence[SearchConfig]) -> DataFrame:
    """One row per question and configuration; the grid is a constant."""
    return questions.select("*", F.explode(config_rows(configs)).alias("c")).select(
        *questions.columns, "c.*")


def reciprocal_rank(hits: DataFrame, questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1/rank of the first hit on exactly the answer page, else 0.

    ``hits``: ``by, qid, rank, page_url``; ``questions``: ``by, qid, source, answer_page_url``.
    """
    keys = [*by, "qid"]
    right = hits.withColumnRenamed("page_url", "answer_page_url")
    found = questions.join(right, [*keys, "answer_page_url"]).groupBy(*keys).agg(F.min("rank").alias("rank"))
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return questions.join(found, keys, "left").select(*keys, "source", rr.alias("rr"))


def score_by_source(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, hit rate and MRR per configuration and source, never pooled."""
    return ranks.groupBy(*by, "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rr") > 0).cast("double")).alias("hit_rate"),
        F.avg("rr").alias("mrr"),
    )


def weighted_overall(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Question-weighted overall figures from per-source rows."""
    n = F.sum("n")
    return scores.groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.col("n") * F.col("hit_rate")) / n).alias("hit_rate"),
        (F.sum(F.col("n") * F.col("mrr")) / n).alias("mrr"),
    )


def leaderboard(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """Place of every configuration within its source, best MRR first."""
    place = F.row_number().over(W.partitionBy("source").orderBy(
        F.round("mrr", 9).desc(), *[F.col(c) for c in order]))
    return scores.withColumn("place", place)


def parse_judge(raw: Column) -> Column:
    """``struct<faithfulness,relevance,reason>``, NULL for a malformed verdict."""
    span = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    reply = jv.parsed(span)
    faith = jv.whole_number(jv.member(reply, "$.faithfulness")).cast("int")
    relevance = jv.whole_number(jv.member(reply, "$.relevance")).cast("int")
    reason = F.coalesce(jv.member(reply, "$.reason").cast("string"), F.lit(""))
    return F.when(
        faith.isNotNull() & relevance.isNotNull(),
        F.struct(faith.alias("faithfulness"), relevance.alias("relevance"), reason.alias("reason")))


def variant_fanout(questions: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """Each question with each (variant, system prompt), over the same hits."""
    table = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(p).alias("system")) for n, p in variants])
    return questions.select("*", F.explode(table).alias("v")).select(*questions.columns, "v.*")


def judge_summary(rows: DataFrame, by: str = "variant") -> DataFrame:
    """Means over judged answers; citation rate and length over all.

    ``rows``: ``variant, faithfulness, relevance, answer``; an unparsed verdict has
    NULL scores. A variant without any verdict gets NULL means.
    """
    judged = F.col("faithfulness").isNotNull() & F.col("relevance").isNotNull()
    perfect = (F.col("faithfulness") == 2) & (F.col("relevance") == 2)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(judged, F.col("faithfulness").cast("double"))).alias("faithfulness_mean"),
        F.avg(F.when(judged, F.col("relevance").cast("double"))).alias("relevance_mean"),
        F.avg(F.when(judged, perfect.cast("double"))).alias("both_perfect_rate"),
        F.avg(text.has_citation(F.col("answer")).cast("double")).alias("citation_rate"),
        F.avg(F.length("answer").cast("double")).alias("avg_answer_chars"),
        F.count_if(~judged).alias("unparsed"),
    )


def recent_experiments(experiments: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` experiment rows."""
    return experiments.orderBy(F.col("id").desc()).limit(n)
