"""Keyword, vector, fusion and re-ranking against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators import evaluation, fusion, keywords, vectors
from pagelore.plans.grid import retrieval_grid
from pagelore.plans.search import Corpus, SearchConfig, config_label, search, stored_config_label

CHUNKS = [
    (1, "refund a payment with the refunds api"),
    (2, "payment intents confirm a payment, then capture the payment"),
    (3, "webhooks tell you about a refund"),
    (4, "capture later: place a hold"),
    (5, "nothing here"),
]


@pytest.fixture(scope="module")
def index(spark):
    return keywords.build_postings(spark.createDataFrame(CHUNKS, "chunk_id long, content string"))


def ask(spark, query, index, match="all"):
    terms = keywords.parse_search_terms(spark.createDataFrame([(7, query)], "qid long, query string"))
    return {r["chunk_id"]: r["score"] for r in keywords.keyword_scores(terms, index, match).collect()}


def test_words_are_anded_or_any(spark, index):
    assert set(ask(spark, "refund payment", index)) == {1}
    assert set(ask(spark, "refund payment", index, "any")) == {1, 2, 3}


def test_rank_saturates_with_frequency(spark, index):
    got = ask(spark, "payment capture", index, "any")
    assert got[2] == pytest.approx((1 + 1 / 4 + 1 / 9 + 1) / 2, abs=1e-9)
    assert got[1] == pytest.approx(0.5)


def test_phrase_needs_neighbours(spark, index):
    assert set(ask(spark, '"a payment"', index)) == {1, 2}
    assert set(ask(spark, '"payment a"', index)) == set()
    assert set(ask(spark, '"a payment" capture', index)) == {2}


def test_negation_and_or(spark, index):
    assert set(ask(spark, "refund -webhooks", index)) == {1}
    assert set(ask(spark, "webhooks or hold", index)) == {3, 4}
    assert set(ask(spark, '-"a payment" refund', index)) == {3}
    assert set(ask(spark, "refund -webhooks", index, "any")) == {1}


def test_nothing_to_search_for(spark, index):
    assert ask(spark, "", index) == {} and ask(spark, "-webhooks", index) == {}
    stops = keywords.parse_search_terms(
        spark.createDataFrame([(1, "the of and")], "qid long, query string"), analyzer="english")
    assert stops.count() == 0


def test_english_analyzer_meets_on_stems(spark):
    index = keywords.build_postings(
        spark.createDataFrame([(1, "The refunded payments"), (2, "other")], "chunk_id long, content string"),
        analyzer="english")
    terms = keywords.parse_search_terms(
        spark.createDataFrame([(1, "refund the payment")], "qid long, query string"), analyzer="english")
    assert [r["chunk_id"] for r in keywords.keyword_topk(terms, index, 5).collect()] == [1]
    assert {r["term"]: r["positions"] for r in index.where("chunk_id = 1").collect()} == {"refund": [1], "payment": [2]}


def test_positions(spark, index):
    rows = {r["term"]: (r["tf"], r["positions"]) for r in index.where("chunk_id = 2").collect()}
    assert rows["payment"] == (3, [0, 4, 8]) and rows["capture"] == (1, [6])


def test_search_stays_inside_the_chunk_partitioning(spark, index):
    terms = keywords.parse_search_terms(spark.createDataFrame([(7, "refund payment")], "qid long, query string"))
    plan = keywords.keyword_topk(terms, index, 5, "any")._jdf.queryExecution().executedPlan().toString()
    # one placement by chunk, one final shuffle by query, limited before it
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_COL") == 1
    assert plan.count("WindowGroupLimit") == 2 and "BroadcastHashJoin" in plan


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(300, 8)).astype("float32")
    corpus[200:260] = corpus[10]            # a group of copies: ties everywhere
    asked = np.vstack([rng.normal(size=(20, 8)), corpus[10]]).astype("float32")
    frame = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(corpus)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(asked)], "qid long, qvec array<float>")
    return frame.repartition(4), queries, corpus.astype(float), asked.astype(float)


def exact(corpus, asked, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(corpus).T, 9)
    return {q: sorted(range(len(corpus)), key=lambda c: (-scores[q, c], c))[:k] for q in range(len(asked))}


def lists(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["chunk_id"])
    return out


def test_vector_topk_is_exact_with_ties(space):
    frame, queries, corpus, asked = space
    assert lists(vectors.vector_topk(queries, frame, 15)) == exact(corpus, asked, 15)


def test_large_query_sets_give_the_same_result(space, monkeypatch):
    frame, queries, corpus, asked = space
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 64)
    hits = vectors.vector_topk(queries, frame, 15)
    assert "FlatMapCoGroupsInArrow" in hits._jdf.queryExecution().executedPlan().toString()
    assert lists(hits) == exact(corpus, asked, 15)


def test_missing_and_zero_vectors_are_left_out(spark, space):
    _, queries, _, _ = space
    rows = spark.createDataFrame(
        [(1, [1.0] * 8), (2, None), (3, [0.0] * 8)], "chunk_id long, embedding array<float>")
    assert set(sum(lists(vectors.vector_topk(queries, rows, 5)).values(), [])) == {1}


@pytest.mark.parametrize("block", [50_000, 20])
def test_lsh_finds_most_neighbours_and_fills_every_query(space, monkeypatch, block):
    frame, queries, corpus, asked = space
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", block)
    near = lists(vectors.vector_topk_lsh(queries, frame, 10, bucket_rows=20))
    truth = exact(corpus, asked, 10)
    assert {q: len(x) for q, x in near.items()} == {q: 10 for q in truth}
    assert sum(len(set(near[q]) & set(truth[q])) for q in truth) >= 0.9 * sum(map(len, truth.values()))


def test_lsh_answers_lonely_queries_exactly(space):
    frame, queries, corpus, asked = space
    assert lists(vectors.vector_topk_lsh(queries, frame, 290, tables=1, probes=1, bucket_rows=2)) == exact(corpus, asked, 290)
    assert vectors.vector_topk_lsh(queries, frame.limit(0), 5).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, chunk_id long, rank int")


def test_rrf_adds_ranks_and_breaks_ties_by_first_seen(spark):
    keyword = ranked(spark, [(1, 10, 1), (1, 11, 2)])
    near = ranked(spark, [(1, 12, 1), (1, 11, 2), (1, 13, 3)])
    got = fusion.rrf_fuse(keyword, near, 60).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [11, 10, 12, 13]
    assert got[0]["score"] == pytest.approx(2 / 62) and got[1]["score"] == got[2]["score"]


def test_rerank_normalizes_within_the_pool(spark):
    rows = [(1, 1, 1, 0.9, None), (1, 2, 2, 0.5, 2.0), (1, 3, 3, 0.1, 4.0), (2, 4, 1, 0.3, None), (2, 5, 2, 0.3, 1.0)]
    pool = spark.createDataFrame(rows, "qid long, chunk_id long, rank int, vec_score double, kw_score double")
    got = {(r["qid"], r["chunk_id"]): r["score"] for r in fusion.rerank_scored(pool, 5).collect()}
    assert got == pytest.approx({(1, 1): 0.7, (1, 2): 0.35, (1, 3): 0.3, (2, 4): 0.7, (2, 5): 1.0})


def test_merge_parts_interleaves_and_caps(spark):
    hits = spark.createDataFrame(
        [(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1), (1, 1, 12, 2)], "qid long, part int, chunk_id long, rank int")
    assert [r["chunk_id"] for r in fusion.merge_parts(hits, 3).orderBy("rank").collect()] == [10, 11, 12]
    assert fusion.merge_parts(hits, 2).count() == 2
    parts = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "qid long, part int")
    assert [r["part"] for r in fusion.skipped_parts(parts, hits).collect()] == [2]


def test_labels(spark):
    grid = evaluation.config_grid()
    rows = evaluation.fan_out(spark.range(1), grid).select("top_k", config_label(
        F.col("mode"), F.col("rrf_k"), F.col("keyword_match"), F.col("rerank"), F.col("query_rewrite")).alias("label")).collect()
    assert len(grid) == 21 and len({(r["label"], r["top_k"]) for r in rows}) == 21
    assert {"hybrid+rrf60", "hybrid+rrf60+kw-any", "keyword+kw-any", "vector", "vector+rerank"} <= {r["label"] for r in rows}


def test_labels_of_stored_configurations(spark):
    rows = ['{"mode":"hybrid"}', '{"mode":"hybrid","rrf_k":20,"keyword_match":"any","rerank":true,"query_rewrite":true}',
            '{"mode":"vector","keyword_match":"any"}', '{"mode":"other"}', "{}", "nope", None]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, c string").select("i", stored_config_label(F.col("c"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["hybrid+rrf60", "hybrid+rrf20+kw-any+rerank+rewrite", "vector", None, None, None, None]


@pytest.fixture(scope="module")
def library(spark, space):
    frame, queries, _, _ = space
    words = ["refund", "payment", "capture", "hold", "webhook", "invoice", "tax"]
    content = F.concat_ws(" ", *[
        F.when(F.pmod(F.xxhash64("chunk_id", F.lit(w)), F.lit(3)) == 0, w) for w in words])
    chunks = frame.withColumns({
        "content": content, "page_url": F.concat(F.lit("p"), F.col("chunk_id") % 11),
        "page_title": F.lit(None).cast("string"), "heading_path": F.lit("h")})
    asked = queries.withColumn("query", F.element_at(
        F.array(*[F.lit(f"{a} {b}") for a, b in zip(words, words[1:])]), (F.col("qid") % 6 + 1).cast("int")))
    return Corpus(chunks, keywords.build_postings(chunks)), asked


def test_grid_equals_one_search_per_configuration(spark, library):
    corpus, queries = library
    truth = queries.select("qid", F.when(F.col("qid") < 9, "a").otherwise("b").alias("source"),
                           F.concat(F.lit("p"), F.col("qid") % 11).alias("answer_page_url"))
    grid = {(r["config"], r["top_k"], r["source"]): (r["n"], r["hit_rate"], r["mrr"])
            for r in retrieval_grid(queries, truth, corpus).collect()}
    for label, cfg in {"keyword+kw-any": SearchConfig("any", vectors=False, top_k=10), "hybrid+rrf60": SearchConfig(top_k=5),
                       "vector+rerank": SearchConfig(None, top_k=20, rerank=True),
                       "hybrid+rrf60+rerank": SearchConfig(top_k=10, rerank=True)}.items():
        hits = search(queries, corpus, cfg, ["page_url"])
        for r in evaluation.score_by_source(evaluation.reciprocal_rank(hits, truth)).collect():
            got = grid[(label, cfg.top_k, r["source"])]
            assert got[0] == r["n"] and all(
                math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[1:], (r["hit_rate"], r["mrr"])))


def test_a_search_needs_a_list():
    for wrong in ({"terms": None, "vectors": False}, {"terms": "some"}):
        with pytest.raises(ValueError):
            SearchConfig(**wrong)


def test_a_passage_searched_by_its_words_has_no_operators(spark, index):
    from pagelore.functions import text

    rows = spark.createDataFrame([(7, 'Hold or -webhooks "a payment" OR')], "qid long, query string")
    terms = keywords.parse_search_terms(rows.withColumn("query", text.plain_query(F.col("query")))).collect()
    assert sorted(r["term"] for r in terms) == ["a", "hold", "or", "payment", "webhooks"]
    assert {(r["clause"], r["negated"], r["len"], r["n_items"], r["n_terms"]) for r in terms} == {(0, False, 1, 5, 5)}


def test_registered_searches_take_an_or_of_the_passage_as_a_word(spark, tmp_path):
    from pagelore.catalog import views
    from pagelore.catalog.registry import Tables
    from pagelore.catalog.retrieval import terms

    spark.createDataFrame([(1, "refund or hold")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = Tables(spark, str(tmp_path))
    assert {(r["term"], r["clause"], r["n_terms"]) for r in terms(t).collect()} == {("refund", 0, 3), ("or", 0, 3), ("hold", 0, 3)}
    web = keywords.parse_search_terms(views.web_queries(t)).where("clause = 1").collect()
    assert {(r["term"], r["n_items"]) for r in web} == {("refund", 3), ("or", 3), ("hold", 3)}
