"""One search entry point driven by a config."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.operators import fusion, keywords, vectors
from pagelore.operators.inverted import StoredIndex
from pagelore.session import settle


@dataclass(frozen=True)
class SearchConfig:
    """Which lists are made for a question, and how they become one.

    ``terms`` asks for a keyword list whose chunks hold ``all`` or ``any`` of the terms,
    ``vectors`` for one by cosine. Two lists are cut at ``depth`` and fused by reciprocal
    rank with the constant ``damping``.
    """

    terms: str | None = "all"
    vectors: bool = True
    top_k: int = 5
    rerank: bool = False
    depth: int = fx.CANDIDATES
    damping: int = fx.RRF_K

    def __post_init__(self):
        if self.terms not in ("all", "any", None) or not (self.terms or self.vectors):
            raise ValueError(f"no such search: {self}")

    @property
    def mode(self) -> str:
        return "hybrid" if self.terms and self.vectors else "keyword" if self.terms else "vector"

    @property
    def pool(self) -> int:
        """How many hits a re-ranking looks at."""
        return max(self.depth, fx.POOL_PER_HIT * self.top_k)


@dataclass(frozen=True)
class Corpus:
    """What a search reads: vectors (``chunk_id, embedding``), the index (postings rows or an
    inverted file; none for searches by vectors alone), and the chunk columns shown with a hit."""

    chunks: DataFrame
    index: DataFrame | StoredIndex | None
    analyzer: str = "simple"


def config_label(mode: Column, damping: Column, terms: Column, rerank: Column, rewrite: Column) -> Column:
    """The name of a configuration row, its unusual settings joined by ``+``."""
    return F.concat_ws(
        "+", mode,
        F.when(mode == "hybrid", F.concat(F.lit("rrf"), damping)),
        F.when((mode != "vector") & (terms != "all"), F.concat(F.lit("kw-"), terms)),
        F.when(rerank, "rerank"),
        F.when(rewrite, "rewrite"),
    )


CONFIG_JSON = "mode string, keyword_match string, rrf_k int, rerank boolean, query_rewrite boolean"


def stored_config_label(config: Column) -> Column:
    """:func:`config_label` of a configuration kept as JSON; settings it does not name have their defaults.
    A text that is no configuration has no label."""
    c = F.from_json(config, CONFIG_JSON)
    label = config_label(
        c["mode"], F.coalesce(c["rrf_k"], F.lit(fx.RRF_K)).cast("string"), F.coalesce(c["keyword_match"], F.lit("all")),
        F.coalesce(c["rerank"], F.lit(False)), F.coalesce(c["query_rewrite"], F.lit(False)))
    return F.when(c["mode"].isin("vector", "keyword", "hybrid"), label)


def label_of(cfg: SearchConfig) -> Column:
    return config_label(F.lit(cfg.mode), F.lit(cfg.damping), F.lit(cfg.terms or "all"), F.lit(cfg.rerank), F.lit(False))


def ranked_ids(queries: DataFrame, corpus: Corpus, cfg: SearchConfig) -> DataFrame:
    """``qid, chunk_id, score, rank`` for ``queries`` (``qid, query, qvec``)."""
    wanted = cfg.pool if cfg.rerank else cfg.top_k
    fused = cfg.mode == "hybrid"
    lists, terms = [], None
    if cfg.terms or cfg.rerank:
        terms = keywords.parse_search_terms(queries, analyzer=corpus.analyzer)
    if cfg.terms:
        lists.append(keywords.keyword_topk(terms, corpus.index, cfg.depth if fused else wanted, cfg.terms))
    if cfg.vectors:
        lists.append(vectors.vector_topk(queries, corpus.chunks, cfg.depth if fused else wanted))
    found = fusion.rrf_fuse(*lists, cfg.damping, wanted) if fused else lists[0]
    if not cfg.rerank:
        return found
    return fusion.rerank_scored(fusion.pool_scores(found, terms, corpus.index, queries, corpus.chunks), cfg.top_k)


def search(queries: DataFrame, corpus: Corpus, cfg: SearchConfig,
           columns: Sequence[str] = ("page_url", "page_title", "heading_path", "content")) -> DataFrame:
    """Hits with their chunk columns, best first by ``rank``. The chunk texts are
    joined last, for the hits alone."""
    # Written first: the planner then sees how small the hits are next to the texts.
    hits = settle(ranked_ids(queries, corpus, cfg), "hits")
    return hits.join(corpus.chunks.select("chunk_id", *columns), "chunk_id").select(
        "qid", "rank", "chunk_id", *columns, "score")
