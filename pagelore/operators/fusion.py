"""Rank fusion, re-ranking and multi-part merging.

All groups here are result pools of one query: bounded by the configured depth.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.functions import vectors
from pagelore.operators import inverted
from pagelore.operators.keywords import SCORE_DIGITS, keyword_scores, top_k
from pagelore.session import settle

if TYPE_CHECKING:
    from pagelore.operators.keywords import Index


def rrf_fuse(keyword: DataFrame, vector: DataFrame, rrf_k: int = 60, k: int | None = None) -> DataFrame:
    """Σ 1/(rrf_k + rank) over the arms; ties go to the first seen: keyword arm
    first, then rank (E7). ``qid, chunk_id, score, rank``."""
    arms = keyword.select("qid", "chunk_id", "rank", F.lit(0).alias("arm")).unionByName(
        vector.select("qid", "chunk_id", "rank", F.lit(1).alias("arm")))
    fused = arms.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("arm", "rank")).alias("seen"),
    )
    rank = F.row_number().over(
        W.partitionBy("qid").orderBy(F.col("score").desc(), "seen"))
    ranked = fused.withColumn("rank", rank).drop("seen")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def min_max(score: Column, pool: W) -> Column:
    """Scale to 0..1 within the pool; equal scores are all 1, a missing one is 0."""
    low, high = F.min(score).over(pool), F.max(score).over(pool)
    return F.when(score.isNull(), 0.0).when(high == low, 1.0).otherwise((score - low) / (high - low))


def rerank_scored(pool: DataFrame, k: int, w_vector: float = 0.7, w_keyword: float = 0.3) -> DataFrame:
    """Re-score ``qid, chunk_id, rank, vec_score, kw_score`` pools; ties keep the
    pool order (E9)."""
    by_query = W.partitionBy("qid")
    score = F.round(
        w_vector * min_max(F.col("vec_score"), by_query)
        + w_keyword * min_max(F.col("kw_score"), by_query), SCORE_DIGITS)
    scored = pool.withColumn("score", score).withColumnRenamed("rank", "pool_rank")
    return top_k(scored, k, "pool_rank").select("qid", "chunk_id", "score", "rank")


def pool_scores(pool: DataFrame, terms: DataFrame, index: Index, queries: DataFrame,
                corpus: DataFrame) -> DataFrame:
    """Both signals for pool members only: ``qid, chunk_id, rank, vec_score, kw_score``.

    The pool's pairs restrict the index, its chunks the corpus, before any scoring."""
    members = settle(pool.select("qid", "chunk_id", "rank"), "pool")
    wanted = members.select("chunk_id").distinct()
    if isinstance(index, DataFrame):
        loose = keyword_scores(terms, index.join(wanted, "chunk_id", "left_semi"), "any", members.select("qid", "chunk_id").distinct())
    else:
        loose = inverted.pair_scores(index, terms, members.select("qid", "chunk_id").distinct())
    near = members.join(
        corpus.select("chunk_id", "embedding").join(wanted, "chunk_id", "left_semi"), "chunk_id", "left"
    ).join(queries.select("qid", "qvec"), "qid", "left")
    vec = near.select(
        "qid", "chunk_id", "rank",
        F.round(vectors.cosine(F.col("qvec"), F.col("embedding")), SCORE_DIGITS).alias("vec_score"))
    return vec.join(loose.withColumnRenamed("score", "kw_score"), ["qid", "chunk_id"], "left")


def merge_parts(hits: DataFrame, cap: int) -> DataFrame:
    """Interleave the hits of a question's parts by rank, keep each chunk once,
    cut at ``cap`` (E12). ``hits``: ``qid, part, chunk_id, rank``."""
    once = hits.groupBy("qid", "chunk_id").agg(F.min(F.struct("rank", "part")).alias("tier"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("tier"))
    return once.select("qid", "chunk_id", rank.alias("rank")).where(F.col("rank") <= cap)


def skipped_parts(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """Parts of a question that found nothing."""
    return parts.join(hits.select("qid", "part").distinct(), ["qid", "part"], "left_anti")
