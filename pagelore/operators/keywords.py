"""Keyword search over a postings index (K1-K6).

Query terms are broadcast and the postings they match are placed by chunk, so scoring
a chunk never needs rows of another partition: sums stay local, and each
task sends at most k rows per query to the final ranking.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore import fixed_values as fx
from pagelore.functions import text
from pagelore.session import materialize, settle

if TYPE_CHECKING:
    from pagelore.operators.inverted import StoredIndex

    #: Postings rows (:func:`build_postings`) or an inverted file.
    Index = DataFrame | StoredIndex

SCORE_DIGITS = 9
TERM_BLOCK = 200_000    # query-term rows broadcast at once
SEARCH_TOKEN = r'-?"[^"]*"|\S+'


def analyze(col: Column, analyzer: str = "simple") -> Column:
    """Terms of a text with their 0-based positions: ``array<struct<term,pos>>``."""
    numbered = F.transform(text.simple_tokens(col),
                           lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    if analyzer == "simple":
        return numbered
    if analyzer != "english":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    stops = F.array(*[F.lit(w) for w in fx.STOP_WORDS])
    words = F.filter(numbered, lambda r: ~F.array_contains(stops, r["term"]))
    stems = _stem_all(F.transform(words, lambda r: r["term"]))
    return F.zip_with(stems, words, lambda s, r: F.struct(s.alias("term"), r["pos"].alias("pos")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(terms: pd.Series) -> pd.Series:
    from pagelore.functions.stemming import stem

    return terms.map(lambda row: [stem(t) for t in row])


def term_weight(tf: Column) -> Column:
    """1 + 1/4 + … + 1/tf²: frequency counts less and less."""
    total = F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0),
                        lambda acc, j: acc + F.lit(1.0) / (j * j).cast("double"))
    return F.when(tf == 1, 1.0).when(tf == 2, 1.25).otherwise(total)


def word_places(words: pa.ChunkedArray | pa.Array, analyzer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, position and term number of every term of lists of words, and the terms. Each distinct
    word is stemmed once; stop words have no term, but their positions count."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), sizes)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = pc.list_flatten(words).dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if analyzer == "simple":
        return row, pos, code, names
    from pagelore.functions.stemming import stem

    stops = set(fx.STOP_WORDS)
    stems = pa.array([None if w in stops else stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
    code = pc.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False)[code]
    kept = code >= 0
    return row[kept], pos[kept], code[kept], stems.dictionary


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end of the last."""
    return np.concatenate([np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)), [len(sorted_keys)]])


def build_postings(chunks: DataFrame, chunk_id: str = "chunk_id", content: Column | str = "content",
                   analyzer: str = "simple") -> DataFrame:
    """``chunk_id, term, tf, positions, weight`` rows (K2).

    A chunk's terms are counted where its text lies, an Arrow batch of texts at a time: nothing is
    shuffled. Only chunks whose id comes more than once have their postings put together.
    """
    if analyzer not in ("simple", "english"):
        raise ValueError(f"unknown analyzer {analyzer!r}")
    content = F.col(content) if isinstance(content, str) else content
    worded = chunks.select(F.col(chunk_id).alias("chunk_id"), text.simple_tokens(content).alias("words"))

    def count(batches):
        for batch in batches:
            row, pos, code, names = word_places(batch.column(1), analyzer)
            order = np.argsort(row * len(names) + code, kind="stable")
            row, code = row[order], code[order]
            at = runs(row * len(names) + code)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row[at[:-1]])), names.take(pa.array(code[at[:-1]])),
                pa.array(np.diff(at), pa.int32()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pos[order], pa.int32())),
            ], ["chunk_id", "term", "tf", "positions"])

    counted = worded.mapInArrow(count, T.StructType([
        T.StructField("chunk_id", worded.schema["chunk_id"].dataType), T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))
    again = materialize(chunks.groupBy(F.col(chunk_id).alias("__again")).count().where("count > 1").select("__again"), "repeated")
    if not again.isEmpty():
        same = F.col("chunk_id").eqNullSafe(F.col("__again"))
        merged = counted.join(again, same, "left_semi").groupBy("chunk_id", "term").agg(
            F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        counted = counted.join(again, same, "left_anti").unionByName(merged)
    return counted.withColumn("weight", term_weight(F.col("tf")))


def parse_search_terms(queries: DataFrame, qid: str = "qid", query: str = "query",
                       analyzer: str = "simple") -> DataFrame:
    """Queries -> term rows (K3).

    Words are AND'd, ``"…"`` is a phrase, a leading ``-`` negates, ``or`` starts
    another clause. ``qid, clause, item, negated, idx, len, term, scored`` plus
    ``n_items`` (positive items of the clause) and ``n_terms`` (distinct positive
    terms of the query). ``scored`` marks the one row per term that carries rank.
    """
    raw = queries.select(
        F.col(qid).alias("qid"),
        F.posexplode(F.regexp_extract_all(F.col(query), F.lit(SEARCH_TOKEN), F.lit(0))).alias("at", "raw"),
    )
    is_or = F.lower("raw") == "or"
    by_query = W.partitionBy("qid").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    raw = raw.withColumn("clause", F.sum(is_or.cast("int")).over(by_query)).where(~is_or)
    quoted = F.col("raw").rlike('^-?"')
    terms = raw.select(
        "qid", "clause", "at", quoted.alias("quoted"), F.col("raw").startswith("-").alias("negated"),
        analyze(F.col("raw"), analyzer).alias("terms"),
    )
    # A word that splits into several terms is several words; a phrase stays one.
    base = F.when(F.size("terms") > 0, F.col("terms")[0]["pos"])
    rows = terms.withColumn("base", base).select(
        "qid", "clause", "at", "negated", "base",
        (F.col("quoted") & (F.size("terms") > 1)).alias("phrase"), F.size("terms").alias("size"),
        F.explode("terms").alias("t"),
    ).select(
        "qid", "clause", "negated", "phrase", F.col("t.term").alias("term"),
        F.when(F.col("phrase"), F.col("at")).otherwise(F.lit(-1)).alias("at"),
        F.when(F.col("phrase"), F.col("t.pos") - F.col("base")).otherwise(F.lit(0)).alias("idx"),
        F.when(F.col("phrase"), F.col("size")).otherwise(F.lit(1)).alias("len"),
    ).distinct()
    item = F.when(F.col("phrase"), F.concat(F.lit("p"), "at")).otherwise(F.concat(F.lit("w:"), "term"))
    rows = rows.withColumn("item", item)
    first = F.row_number().over(
        W.partitionBy("qid", "term").orderBy("negated", "clause", "at", "idx"))
    rows = rows.withColumn("scored", (first == 1) & ~F.col("negated"))
    clause = W.partitionBy("qid", "clause")
    n_items = F.size(F.collect_set(F.when(~F.col("negated"), F.col("item"))).over(clause))
    n_terms = F.sum(F.col("scored").cast("int")).over(W.partitionBy("qid"))
    return rows.select(
        "qid", "clause", "item", "negated", "idx", "len", "term", "scored",
        n_items.alias("n_items"), n_terms.alias("n_terms"),
    )


def _names(terms: DataFrame) -> set[str]:
    """The distinct terms of at most ``TERM_BLOCK`` rows."""
    return {r[0] for r in terms.select("term").distinct().collect()}


def phrase_matches(phrases: DataFrame, index: Index) -> DataFrame:
    """:func:`phrase_hits` of parsed phrase rows: in a stored index within its parts, in postings rows by
    a join, where the phrases are broadcast within ``TERM_BLOCK`` rows only."""
    if not isinstance(index, DataFrame):
        from pagelore.operators import inverted

        return inverted.phrases(index, phrases)
    phrases = settle(phrases, "terms")
    small = phrases.count() <= TERM_BLOCK
    return phrase_hits(index.join(F.broadcast(phrases) if small else phrases, "term"))


def phrase_hits(matched: DataFrame) -> DataFrame:
    """Phrases found in a chunk: one start position shared by all their terms (K5)."""
    starts = matched.where(F.col("len") > 1).select(
        "chunk_id", "qid", "clause", "item", "negated", "len", "idx", "n_items", "n_terms",
        F.explode("positions").alias("pos"),
    )
    whole = starts.groupBy(
        "chunk_id", "qid", "clause", "item", "negated", "len", "n_items", "n_terms",
        (F.col("pos") - F.col("idx")).alias("start"),
    ).agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == F.col("len"))
    return whole.select(
        "chunk_id", "qid", "clause", "item", "negated", "n_items", "n_terms").distinct()


def keyword_matches(terms: DataFrame, index: Index, pairs: DataFrame | None = None) -> DataFrame:
    """``qid, chunk_id, score, matches_all`` for every chunk a query matches.

    ``all``: every positive item of some clause is present. ``any``: at least one
    is. Chunks holding a negated item of the clause never match (K6).
    rank = (1/|Q|) · Σ over query terms of the term weight. With ``pairs`` (qid, chunk_id)
    nothing else is scored. In a stored index chunks are matched within its parts.
    """
    if pairs is None and not isinstance(index, DataFrame):
        from pagelore.operators import inverted

        return inverted.matches(index, terms)
    terms = settle(terms, "terms")
    seen = terms.agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"), F.max("clause").alias("clause")).first()
    rows = index if isinstance(index, DataFrame) else index.postings(_names(terms) if seen["n"] <= TERM_BLOCK else None)
    found = rows.join(F.broadcast(terms) if seen["n"] <= TERM_BLOCK else terms, "term")
    if rows is index:   # what matches is placed by chunk once; every sum keeps that placement
        found = found.repartition("chunk_id")
    if pairs is not None:
        found = found.join(pairs, ["qid", "chunk_id"], "left_semi")
    weight = F.when(F.col("scored"), F.col("weight")).otherwise(F.lit(0.0))
    single = F.col("len") == 1
    facts = found.select(
        "chunk_id", "qid", "clause", "n_items", "n_terms", weight.alias("w"),
        (single & ~F.col("negated")).cast("int").alias("hit"),
        (single & F.col("negated")).cast("int").alias("bad"),
    )
    if (seen["len"] or 0) > 1:
        facts = facts.unionByName(phrase_hits(found).select(
            "chunk_id", "qid", "clause", "n_items", "n_terms", F.lit(0.0).alias("w"),
            (~F.col("negated")).cast("int").alias("hit"), F.col("negated").cast("int").alias("bad"),
        ))
    several = (seen["clause"] or 0) > 0
    clauses = facts.groupBy("chunk_id", "qid", *(["clause"] if several else [])).agg(
        F.sum("w").alias("w"), F.sum("hit").alias("hits"), F.sum("bad").alias("bad"),
        F.max("n_items").alias("n_items"), F.max("n_terms").alias("n_terms"),
    )
    allowed = (F.col("bad") == 0) & (F.col("hits") > 0)
    complete = allowed & (F.col("hits") >= F.col("n_items"))
    if not several:
        return clauses.where(allowed).select(
            "qid", "chunk_id", F.round(F.col("w") / F.col("n_terms"), SCORE_DIGITS).alias("score"),
            complete.alias("matches_all"))
    return clauses.groupBy("chunk_id", "qid").agg(
        F.max(allowed).alias("matches_any"), F.max(complete).alias("matches_all"),
        F.round(F.sum("w") / F.max("n_terms"), SCORE_DIGITS).alias("score"),
    ).where("matches_any").select("qid", "chunk_id", "score", "matches_all")


def keyword_scores(terms: DataFrame, index: Index, match: str = "all", pairs: DataFrame | None = None) -> DataFrame:
    """``qid, chunk_id, score`` of the matching chunks."""
    if match not in ("all", "any"):
        raise ValueError(f"unknown match {match!r}")
    if match == "all" and pairs is None and not isinstance(index, DataFrame):
        from pagelore.operators import inverted

        return inverted.matches(index, terms, whole=True).select("qid", "chunk_id", "score")
    matches = keyword_matches(terms, index, pairs)
    if match == "all":
        matches = matches.where("matches_all")
    return matches.select("qid", "chunk_id", "score")


def query_blocks(terms: DataFrame) -> list[DataFrame]:
    """Query terms in stored blocks small enough to broadcast, whole queries each.

    A large question set then reads the index once per block, and no match leaves
    its task before it is ranked; one join with all terms would shuffle them all."""
    terms = settle(terms, "terms")
    n = ceil(terms.count() / TERM_BLOCK)
    if n <= 1:
        return [terms]
    block = F.pmod(F.xxhash64("qid"), F.lit(2 * n))
    return [settle(terms.where(block == i), "terms") for i in range(2 * n)]


def keyword_topk_both(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """Both lists in one pass over the index: ``match, qid, chunk_id, score, rank``."""
    if not isinstance(index, DataFrame):
        from pagelore.operators import inverted

        return inverted.topk(index, terms, k)
    return reduce(DataFrame.unionByName, [_topk_both(b, index, k) for b in query_blocks(terms)])


def _topk_both(terms: DataFrame, index: DataFrame, k: int) -> DataFrame:
    matches = keyword_matches(terms, index)
    kinds = F.when(F.col("matches_all"), F.array(F.lit("all"), F.lit("any"))).otherwise(F.array(F.lit("any")))
    rows = matches.select("qid", "chunk_id", "score", F.explode(kinds).alias("match"))
    rank = F.row_number().over(W.partitionBy("qid", "match").orderBy(F.col("score").desc(), "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(scores: DataFrame, k: int, *tie: str) -> DataFrame:
    """Best ``k`` rows per query with their rank. Spark limits each task to ``k``
    rows per query before the shuffle (WindowGroupLimit)."""
    order = [F.col("score").desc(), *[F.col(c) for c in (tie or ("chunk_id",))]]
    rank = F.row_number().over(W.partitionBy("qid").orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_topk(terms: DataFrame, index: Index, k: int, match: str = "all") -> DataFrame:
    """``qid, chunk_id, score, rank`` (K4), from postings rows or from a stored index."""
    if not isinstance(index, DataFrame):
        from pagelore.operators import inverted

        if match not in ("all", "any"):
            raise ValueError(f"unknown match {match!r}")
        return inverted.topk(index, terms, k, (match,)).drop("match")
    return reduce(DataFrame.unionByName, [
        top_k(keyword_scores(b, index, match), k) for b in query_blocks(terms)])
