"""Retrieval evaluation over a whole configuration grid in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators import evaluation, fusion, keywords, vectors
from pagelore.plans.search import Corpus, SearchConfig, label_of
from pagelore.session import materialize


def _lists(cfg: SearchConfig) -> str:
    """Name of the ranked list a configuration reads."""
    return f"{cfg.mode}-{cfg.terms}" if cfg.terms else cfg.mode


def _uses(configs: Sequence[SearchConfig], name: str) -> Column:
    """Configurations reading one list, as an array literal."""
    rows = [
        F.struct(F.lit(i).alias("config_id"), F.lit(c.pool if c.rerank else c.top_k).alias("depth"),
                 F.lit(c.top_k).alias("top_k"), F.lit(c.rerank).alias("rerank"))
        for i, c in enumerate(configs) if _lists(c) == name
    ]
    return F.array(*rows)


def grid_hits(queries: DataFrame, corpus: Corpus, configs: Sequence[SearchConfig]) -> DataFrame:
    """``config_id, qid, chunk_id, rank`` for every configuration.

    Each arm is searched once at the greatest depth any configuration needs;
    every smaller k, fusion and re-ranking is cut from those lists."""
    if len({(c.damping, c.depth) for c in configs}) > 1:
        raise ValueError("a grid shares one fusion constant and one depth")
    candidates, damping = configs[0].depth, configs[0].damping
    depth = max([candidates, *[c.pool if c.rerank else c.top_k for c in configs]])
    names = sorted({_lists(c) for c in configs})
    terms = materialize(keywords.parse_search_terms(queries, analyzer=corpus.analyzer), "terms")

    arms: dict[str, DataFrame] = {}
    if any(c.terms for c in configs):
        both = materialize(keywords.keyword_topk_both(terms, corpus.index, depth), "arm")
        arms = {f"keyword-{m}": both.where(F.col("match") == m).drop("match") for m in ("all", "any")}
    if any(c.vectors for c in configs):
        arms["vector"] = materialize(vectors.vector_topk(queries, corpus.chunks, depth), "arm")

    rows: DataFrame | None = None
    for name in names:
        if name.startswith("hybrid-"):
            within = F.col("rank") <= candidates
            ranked = fusion.rrf_fuse(
                arms["keyword-" + name.removeprefix("hybrid-")].where(within), arms["vector"].where(within), damping)
        else:
            ranked = arms[name]
        used = ranked.select("qid", "chunk_id", "rank", F.explode(_uses(configs, name)).alias("c"))
        part = used.select("qid", "chunk_id", "rank", "c.*").where(F.col("rank") <= F.col("depth"))
        rows = part if rows is None else rows.unionByName(part)
    if not any(c.rerank for c in configs):
        return rows.select("config_id", "qid", "chunk_id", "rank")

    lists = materialize(rows, "lists")
    plain = lists.where(~F.col("rerank")).select("config_id", "qid", "chunk_id", "rank")
    pools = lists.where("rerank")
    members = materialize(pools.select("qid", "chunk_id").distinct().withColumn("rank", F.lit(0)), "pool")
    signals = fusion.pool_scores(members, terms, corpus.index, queries, corpus.chunks).drop("rank")
    scored = pools.join(signals, ["qid", "chunk_id"])
    return plain.unionByName(_rerank_all(scored))


def _rerank_all(pools: DataFrame) -> DataFrame:
    """Re-rank the pools of many configurations at once."""
    key = F.struct("config_id", "qid", "top_k")
    ranked = fusion.rerank_scored(
        pools.select(key.alias("qid"), "chunk_id", "rank", "vec_score", "kw_score"), 2**31 - 1)
    return ranked.where(F.col("rank") <= F.col("qid.top_k")).select(
        "qid.config_id", "qid.qid", "chunk_id", "rank")


def retrieval_grid(queries: DataFrame, questions: DataFrame, corpus: Corpus,
                   configs: Sequence[SearchConfig] | None = None) -> DataFrame:
    """Scores per configuration and source. ``questions``: ``qid, source,
    answer_page_url``."""
    configs = list(configs or evaluation.config_grid())
    hits = materialize(grid_hits(queries, corpus, configs), "hits")
    shown = hits.select("chunk_id").distinct()
    urls = corpus.chunks.select("chunk_id", "page_url").join(shown, "chunk_id", "left_semi")
    fanned = evaluation.fan_out(questions, configs).select("config_id", "qid", "source", "answer_page_url")
    ranks = evaluation.reciprocal_rank(hits.join(urls, "chunk_id"), fanned, ["config_id"])
    scores = evaluation.score_by_source(ranks, ["config_id"])
    labels = F.array(*[label_of(c) for c in configs])
    depths = F.array(*[F.lit(c.top_k) for c in configs])
    return scores.select(
        "config_id", labels[F.col("config_id")].alias("config"), depths[F.col("config_id")].alias("top_k"),
        "source", "n", "hit_rate", "mrr")
