"""Batch Q&A and evaluation steps."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagelore import fixed_values as fx
from pagelore.catalog.scoring import echo_generator
from pagelore.operators import evaluation, keywords, qa, vectors
from pagelore.plans.answering import Prompts, answer_batch
from pagelore.plans.search import Corpus, SearchConfig
from pagelore.schemas import COMPLETION_CACHE

# Workers do not import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
KEYS = [key for key, _ in fx.FLOW_PATTERNS]


def route(spark, *replies):
    rows = spark.createDataFrame([(i, "own question", r) for i, r in enumerate(replies)],
                                 "qid long, question string, raw string")
    return [r for r in qa.validate_flow_choice(qa.parse_route(rows), KEYS).orderBy("qid").collect()]


def test_router_replies(spark):
    fenced, prose, broken, missing, null_subs, listed, as_text, number = route(
        spark,
        '```json\n{"in_scope": true, "sub_questions": [" a ", "", 3, "b", "c", "d"], "sandbox_flow": "dispute", "sandbox_params": {"x": 1}}\n```',
        'Sure {"in_scope": true, "sub_questions": [], "sandbox_flow": "made_up", "sandbox_params": {"x": 1}, "reason": "r"} ok',
        '{"in_scope": true', '{"sub_questions": ["a"]}', '{"in_scope": true, "sub_questions": null}', "[1, 2]",
        '{"in_scope": "no", "sub_questions": "ab c", "sandbox_flow": "dispute", "sandbox_params": [1]}', '{"in_scope": 0}')
    assert fenced["sub_questions"] == ["a", "b", "c"] and fenced["sandbox_flow"] == "dispute"
    assert json.loads(fenced["sandbox_params"]) == {"x": 1}
    assert prose["sub_questions"] == ["own question"] and prose["sandbox_flow"] is None and prose["reason"] == "r"
    assert prose["sandbox_params"] == "{}"
    for failed in (broken, null_subs, listed):
        assert failed["in_scope"] and failed["sub_questions"] == ["own question"] and failed["route_error"]
    assert not missing["in_scope"] and missing["sub_questions"] == ["a"] and missing["route_error"] is None
    assert as_text["in_scope"] and as_text["sub_questions"] == ["a", "b", "c"] and as_text["sandbox_params"] == "{}"
    assert not number["in_scope"] and number["sub_questions"] == []


def coerced(spark, flow, params):
    rows = spark.createDataFrame([(1, flow, json.dumps(params))], "qid long, sandbox_flow string, sandbox_params string")
    return {r["name"]: r["value"] for r in qa.coerce_params(rows, qa.flow_param_specs(spark), ["qid"]).collect()}


@pytest.mark.parametrize("given, kept", [
    (900, "900"), ("12", "50"), (12.7, "50"), (99.9, "99"), ("99.9", "2000"), (10**9, "1000000"), (-5, "50"),
    (None, "2000"), ("x", "2000"), ([1], "2000"), (True, "50"), ("1_000", "1000")])
def test_numbers_are_clamped_or_defaulted(spark, given, kept):
    assert coerced(spark, "charge_card", {"amount_cents": given, "unknown": 1}) == {"amount_cents": kept}


def test_choices_and_missing_parameters(spark):
    assert coerced(spark, "declined_card", {"decline_type": "insufficient_funds"}) == {"decline_type": "insufficient_funds"}
    assert coerced(spark, "declined_card", {"decline_type": 3}) == {"decline_type": "generic"}
    assert coerced(spark, "subscription_trial", {"trial_days": 0}) == {"monthly_amount_cents": "1200", "trial_days": "1"}


def test_first_pattern_wins(spark):
    rows = spark.createDataFrame([
        ("Get my MONEY BACK from a hold",), ("start a free trial subscription",), ("unrelated",), ("I want to pay",)], "q string")
    assert [r[0] for r in rows.select(qa.match_flow(F.col("q"))).collect()] == [
        "payment_and_refund", "subscription_trial", None, "charge_card"]


def test_cache_hits_misses_and_damage(spark):
    ask = [(1, "s", "a"), (2, "s", "b"), (3, "s", "b"), (4, "s", "c"), (5, "s", "boom"), (6, "s", "boom")]
    requests = spark.createDataFrame(ask, "rid long, system string, user string").withColumns(
        {"temperature": F.lit(0.0), "model": F.lit(None).cast("string")})
    keys = {r["rid"]: r["cache_key"] for r in qa.with_cache_key(requests).collect()}
    cache = spark.createDataFrame(
        [(keys[1], "p", "m", "known", 1, 2), (keys[4], "p", "m", None, 1, 2)], COMPLETION_CACHE)
    calls = spark.sparkContext.accumulator(0)

    def generator():
        def call(frame):
            calls.add(len(frame))
            return [RuntimeError("down") if u == "boom" else {"text": u.upper(), "provider": "x", "model": "y",
                                                             "prompt_tokens": 3, "completion_tokens": None}
                    for u in frame["user"]]
        return call

    answers, new = qa.cached_generate(requests, cache, generator)
    got = {r["rid"]: (r["text"], r["cached"], r["error"]) for r in answers.collect()}
    assert got == {1: ("known", True, None), 2: ("B", False, None), 3: ("B", False, None), 4: ("C", False, None),
                   5: (None, False, "down"), 6: (None, False, "down")}
    assert {r["text"] for r in new.collect()} == {"B", "C"}
    assert calls.value == 3   # b, c and boom once each, however often the result is read


def hits(spark, *rows):
    return spark.createDataFrame(
        [(1, *r) for r in rows], "qid long, rank int, page_url string, page_title string, heading_path string, content string")


def test_context_and_citations(spark):
    found = hits(spark, (1, "u1", "T", "H", "c" * 4001), (2, "u2", None, "", "two"), (3, "u1", "T", "H", "three"),
                 (4, "u2", None, "Other", "four"))
    first, second = qa.context_block(found).first()["context"].split("\n\n---\n\n")[:2]
    assert first == "[1] T — H\nSource: u1\n\n" + "c" * 4000 + "\n[… excerpt truncated]"
    assert second == "[2] u2\nSource: u2\n\ntwo"
    assert qa.judge_context(found).first()["context"].startswith("[1] u1\n" + "c" * 3000 + "\n\n---\n\n[2] u2\ntwo")
    pages = qa.group_citations(found).orderBy("first_index").collect()
    assert [(p["page_url"], p["markers"], p["heading"]) for p in pages] == [("u1", "[1][3]", "H"), ("u2", "[2][4]", None)]


def test_question_block(spark):
    rows = spark.createDataFrame([("q", ["a"]), ("q", ["a", "b"])], "q string, parts array<string>")
    one, two = [r[0] for r in rows.select(qa.question_block(F.col("q"), F.col("parts"))).collect()]
    assert one == "q"
    assert two == "q\n\nThis question has 2 parts:\n1. a\n2. b\n\nAnswer each part under its own markdown heading."


def test_events_of_a_run(spark):
    columns = "event_id string, type string, created long, object_id string, payment_intent string, subscription string, customer string, setup_intent string"
    events = spark.createDataFrame([
        ("e1", "charge.succeeded", 5, "ch", "pi", None, None, None), ("e2", "payment_intent.created", 5, "pi", None, None, None, None),
        ("e3", "x.unknown", 5, "z", None, "sub", None, None), ("e4", "customer.created", 4, "cus", None, None, "cus", None),
        ("e5", "setup_intent.created", 6, "q", None, None, None, "seti"), ("e6", "charge.succeeded", 9, "other", "no", None, None, None)], columns)
    touched = spark.createDataFrame([(1, r, 5) for r in ("pi", "sub", "cus", "seti")], "run_id long, ref_id string, window_start long")
    rows = qa.correlate_events(events, touched).orderBy("created", "lifecycle_pos", "event_id").collect()
    assert [r["event_id"] for r in rows] == ["e2", "e1", "e3", "e5"]   # e4 is before the window


@pytest.mark.parametrize("hot", [100_000, 3])
def test_windows_with_an_end_equal_a_nested_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(qa, "HOT_EVENTS", hot)
    rng = random.Random(6)
    some = lambda kind: rng.choice([None, f"{kind}{rng.randint(0, 3)}"])
    events = [(f"e{i}", "charge.succeeded", rng.choice([None, rng.randint(-60, 400)]), f"o{i}", some("pi"), some("s"), "c0", some("seti"))
              for i in range(120)]
    touched = [(r, ref, start, rng.choice([None, start - 1, start, start + rng.randint(0, 300)]))
               for r in range(12) for start in [rng.randint(-80, 300)] for ref in ("c0", f"o{r}", f"s{r % 4}", None)]
    got = qa.correlate_events(
        spark.createDataFrame(events, "event_id string, type string, created long, object_id string, payment_intent string, "
                                      "subscription string, customer string, setup_intent string"),
        spark.createDataFrame(touched, "run_id long, ref_id string, window_start long, window_end long"), bin_width=50)
    wanted = {(r, e[0]) for r, ref, low, high in touched for e in events
              if ref is not None and ref in e[3:] and e[2] is not None and high is not None and low <= e[2] <= high}
    rows = [(r["run_id"], r["event_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted and wanted


def test_null_fields_drop_but_list_items_stay(spark):
    value = F.struct(F.lit(None).cast("string").alias("a"), F.array(F.lit(None).cast("int"), F.lit(1)).alias("b"))
    assert spark.range(1).select(qa.drop_null_fields(value)).first()[0] == '{"b":[null,1]}'


def test_verdicts(spark):
    raw = ['x {"faithfulness": "2", "relevance": 1.9, "reason": "ok"} y', '{"faithfulness": 2}', "none",
           '{"faithfulness": null, "relevance": 1}', '{"faithfulness": "2.5", "relevance": 1}']
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(evaluation.parse_judge(F.col("raw")).alias("j"))
    assert [r["j"] and tuple(r["j"]) for r in rows.collect()] == [(2, 1, "ok"), None, None, None, None]


def test_judge_summary_without_verdicts(spark):
    rows = spark.createDataFrame([("v", 2, 2, "a [1]"), ("v", None, None, "bb"), ("w", None, None, "c")],
                                 "variant string, faithfulness int, relevance int, answer string")
    v, w = evaluation.judge_summary(rows).orderBy("variant").collect()
    assert (v["both_perfect_rate"], v["citation_rate"], v["avg_answer_chars"], v["unparsed"]) == (1.0, 0.5, 3.5, 1)
    assert w["faithfulness_mean"] is None and w["unparsed"] == 1


def test_published_weighted_figures(spark):
    rows = spark.createDataFrame([("c", 43, 0.698, 0.464), ("c", 12, 0.833, 0.597)], "config string, n long, hit_rate double, mrr double")
    r = evaluation.weighted_overall(rows, ["config"]).first()
    assert round(r["hit_rate"], 3) == 0.727 and round(r["mrr"], 3) == 0.493


def test_ground_truth_gate(spark):
    truth = evaluation.build_ground_truth(
        spark.createDataFrame([(1, "q1", "s1"), (2, "q2", "s2")], "lineno long, question string, source_url string"),
        spark.createDataFrame([(2, "/a")], "lineno long, path string"),
        spark.createDataFrame([("w", "/b")], "question string, path string"), "https://d")
    assert sorted((r["question"], r["source"]) for r in truth.collect()) == [("q2", "harvested"), ("w", "synthetic")]
    pages = spark.createDataFrame([("https://d/a",)], "url string")
    with pytest.raises(ValueError, match="https://d/b"):
        evaluation.require_answers(truth, pages)


def model():
    echo = echo_generator()

    def call(frame):
        out = echo(frame)
        for i, (system, user) in enumerate(zip(frame["system"], frame["user"])):
            if system == "route":
                if "router down" in user:
                    out[i] = RuntimeError("timeout")
                else:
                    out[i]["text"] = json.dumps({
                        "in_scope": "poem" not in user, "sub_questions": user.split(" AND "), "sandbox_flow": "charge_card"})
            elif "answer down" in user:
                out[i] = RuntimeError("no provider")
            else:
                out[i]["text"] = "**Code sample**\n```js\nx\n```\n[1]"
        return out

    return call


def test_answer_batch(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(1, "u1", "T1", "H", "refund a payment"), (2, "u2", None, None, "capture a hold"), (3, "u3", "T3", "", "refund again")],
        "chunk_id long, page_url string, page_title string, heading_path string, content string"
    ).withColumn("embedding", F.lit(None).cast("array<float>"))
    corpus = Corpus(chunks, keywords.build_postings(chunks))
    asked = spark.createDataFrame([
        (1, "refund"), (2, "write a poem"), (3, "zebra"), (4, "refund AND zebra"), (5, "refund router down"),
        (6, "refund answer down"), (7, "x" * 1501), (8, "refund sk_test_secret"), (9, None)], "qid long, question string")
    cache = str(tmp_path / "cache")
    out = {r["qid"]: r for r in answer_batch(
        asked, corpus, SearchConfig("any", vectors=False, top_k=10), Prompts("route", "answer"),
        spark.createDataFrame([], COMPLETION_CACHE), model, vectors.hashed_term_encoder(8), cache).collect()}
    assert {q: r["route"] for q, r in out.items()} == {
        1: "docs", 2: "refused", 3: "refused", 4: "docs", 5: "docs", 6: "error", 7: "refused", 8: "docs", 9: "refused"}
    assert [h["page_url"] for h in out[1]["retrieved"]] == ["u1", "u3"] and out[1]["sandbox_flow"] == "charge_card"
    assert "nothing for: zebra" in out[4]["answer"] and "nothing for" not in out[1]["answer"]
    assert out[5]["sandbox_flow"] == "payment_and_refund"       # the pattern, as the router failed
    assert out[6]["answer"] == Prompts("", "").failure and out[6]["error"] == "no provider" and out[6]["sandbox_flow"] is None
    assert out[2]["retrieved"] is None and out[8]["question"] == "refund [redacted key]"
    assert out[7]["error"] == "question too long" and out[9]["error"] == "no question" and out[9]["router"] is None
    verdict = json.loads(out[4]["router"])
    assert verdict["sub_questions"] == ["refund", "zebra"] and verdict["usage"]["cached"] is False
    assert json.loads(out[5]["router"])["error"] == "timeout"
    assert out[6]["latency_ms"] == 0 and out[1]["latency_ms"] is None and out[1]["retrieval_config"] == "keyword+kw-any@10"

    def silent():
        def call(frame):
            raise AssertionError("a second batch makes no call")
        return call

    again = {r["qid"]: r for r in answer_batch(
        asked.where("qid not in (5, 6)"), corpus, SearchConfig("any", vectors=False, top_k=10), Prompts("route", "answer"),
        spark.read.parquet(cache), silent, vectors.hashed_term_encoder(8)).collect()}
    assert {q: r["answer"] for q, r in again.items()} == {q: r["answer"] for q, r in out.items() if q not in (5, 6)}
    assert again[1]["cached"] and json.loads(again[1]["router"])["usage"]["cached"]


def test_parameters_are_coerced_after_one_parse_of_a_reply(spark):
    from pagelore.catalog import answers
    from pagelore.catalog.registry import Tables

    rows = answers.q6(Tables(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1
    assert rows.count() > 0
    odd = spark.createDataFrame([(1, None, "{}"), (2, "no_flow", "{}"), (3, "declined_card", None)],
                                "qid long, sandbox_flow string, sandbox_params string")
    assert {r["qid"] for r in qa.coerce_params(odd, qa.flow_param_specs(spark), ["qid"]).collect()} == {3}
