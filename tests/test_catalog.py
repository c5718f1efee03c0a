"""Registered queries against their SQL on the smallest tables.

One of each kind by default; PAGELORE_ALL_QUERIES=1 runs them all, as does check.py.
"""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"
CHOSEN = """s2_write_raw_snapshot s7_read_questions s9_append_experiments v3_scd2_merge v5_changes_between x3_section_prose
x6_dedupe_first c1_split_sections k2_build_postings k4_keyword_topk_all k6_negation_filter e2_embed_missing
e5_vector_topk e8_hybrid_topk e9_rerank e12_merged_search g5_retrieval_grid g8_parse_judge m2_outcomes_per_day
m3_recent_questions m7_api_calls_per_day m10_latency_per_hour m12_rated_answers m15_burst_count q3_parse_route
q6_coerce_params q9_cached_generate q11_context_block q18_correlate_events t1_stream_questions_per_hour""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("PAGELORE_ALL_QUERIES") else CHOSEN)
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, SF, name) == ""


@pytest.mark.parametrize("name", ["v4_as_of", "v5_drift_by_section"])
def test_history_agrees_with_sql_where_changes_are_marked_by_bitmaps(spark, duck, monkeypatch, name):
    from pagelore.operators import sieve

    made, bitmaps = [], sieve._bitmaps
    monkeypatch.setattr(sieve, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sieve, "_bitmaps", lambda *args: made.append(1) or bitmaps(*args))
    assert compare(spark, duck, SF, name) == "" and len(made) >= 4   # labels, versions that end, pages that open


def test_drift_by_section_shuffles_no_text_in_any_step(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from pagelore.operators import sieve

    frames, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(sieve, "BROADCAST_ROWS", 10)   # every set of changes is large
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **kw: frames.append(self._df) or write(self, *args, **kw))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames.append(queries()["v5_drift_by_section"](spark, SF))
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plans = [f._jdf.queryExecution().explainString(formatted) for f in frames]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [m for plan in plans for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert len(frames) > 5 and any("row_hash" in m for m in moved)
    assert not [m for m in moved if re.search(r"\b(content|text|html)#", m)]


def test_registered_approximate_search_is_whole_and_near_the_exact_one(spark):
    exact, near = ({(r["qid"], r["chunk_id"]) for r in queries()[name](spark, SF).collect()} for name in ("e5_vector_topk", "e6_vector_topk_lsh"))
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


def test_flagship_runs(spark):
    rows = entry(spark)
    assert rows.columns == ["source", "n", "hit_rate", "mrr"] and rows.count() == 2


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100


@pytest.mark.parametrize("name", ["k4_keyword_topk_any", "v3_scd2_merge", "c5_chunk_pages", "m15_burst_count", "e9_rerank"])
def test_plans_hold_at_scale(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Exchange SinglePartition", plan)


def test_scans_read_only_what_is_used(spark):
    plan = queries()["m10_latency_per_hour"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_a_time_range_leaves_the_folders_of_other_days_unread(spark, tmp_path):
    from pyspark.sql import functions as F

    from pagelore.operators import monitoring

    path = str(tmp_path / "log")
    days = spark.range(10).selectExpr("id", "timestamp_ntz '2024-01-01 12:00:00' + make_dt_interval(id) as asked_at")
    days.withColumn("asked_on", F.to_date("asked_at")).write.partitionBy("asked_on").parquet(path)
    ends = [F.lit(f"2024-01-0{d} 12:00:00").cast("timestamp_ntz") for d in (3, 5)]
    some = monitoring.in_range(spark.read.parquet(path), *ends)
    assert sorted(r["id"] for r in some.collect()) == [2, 3, 4] and len(some.inputFiles()) >= 3
    plan = some._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "asked_on" in pruned and ">=" in pruned and "<=" in pruned


@pytest.mark.parametrize("name", [n for n in queries() if n.startswith("m") and n.endswith("_in_range")])
def test_panels_over_a_range_read_the_folders_of_their_days(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pruned = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
    assert any("asked_on" in p and ">=" in p and "<=" in p for p in pruned)


def test_the_last_days_prune_folders_and_equal_bounds_prune_on_both_sides(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from pagelore.operators import monitoring

    now = datetime.now()
    rows = [(i, now - timedelta(days=i)) for i in range(20)]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, "id long, asked_at timestamp").withColumn("asked_on", F.to_date("asked_at")).write.partitionBy("asked_on").parquet(path)
    last = monitoring.last_days(spark.read.parquet(path), 7)
    assert sorted(r["id"] for r in last.collect()) in ([*range(7)], [*range(8)])
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "asked_on" in plan.split("PartitionFilters: [")[1].split("]")[0]
    same = F.lit(rows[3][1])
    once = monitoring.in_range(spark.read.parquet(path), same, same)
    pruned = once._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert [r["id"] for r in once.collect()] == [3] and ">=" in pruned and "<=" in pruned


def test_long_texts_reach_python_in_batches_of_bounded_size(spark, tmp_path):
    import pyarrow as pa

    from pagelore.catalog.registry import Tables

    path = f"{tmp_path}/documents.parquet"
    spark.range(0, 120, 1, 1).selectExpr("id", "repeat('x', 200000) AS text").write.parquet(path)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    rows = Tables(spark, str(tmp_path)).documents.mapInArrow(sizes, "n long").collect()
    assert max(r["n"] for r in rows) < 6 << 20 and sum(r["n"] for r in rows) > 120 * 200_000
