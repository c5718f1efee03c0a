"""The stored history against merges of whole frames."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagelore.operators import versioning
from pagelore.sources import history as h
from pagelore.sources.history import StoredHistory

COLS = ["title", "content"]
SCHEMA = "url string, section string, title string, content string"


def day(n):
    return datetime(2024, 1, n)


def ntz(n):
    return F.lit(f"2024-01-{n:02d} 00:00:00").cast("timestamp_ntz")


def rows(frame):
    return sorted((tuple(r) for r in frame.select("url", "section", "title", "content", "row_hash", "valid_from", "valid_to").collect()), key=str)


def page(i, content="same"):
    return (f"u{i}", "s", f"t{i}", content)


@pytest.fixture
def stored(spark, tmp_path):
    return StoredHistory(spark, str(tmp_path / "h"), COLS, buckets=8)


def test_merges_equal_those_of_frames(spark, stored):
    rng = random.Random(1)
    whole = None
    for n in range(1, 5):
        load = spark.createDataFrame([page(i, rng.choice("ab")) for i in range(30) if rng.random() < 0.8] + [(None, "s", "t", "c")], SCHEMA)
        stored.merge(load, day(n))
        whole = versioning.first_load(load, ntz(n), COLS) if whole is None else versioning.scd2_merge(whole, load, ntz(n), COLS)
        got, wanted = rows(stored.read().where("url IS NOT NULL")), rows(whole.where("url IS NOT NULL"))
        assert got == wanted and stored.loads() == n
    assert rows(stored.current().where("url IS NOT NULL")) == rows(versioning.read_current_pages(whole).where("url IS NOT NULL"))
    for n in range(1, 5):
        assert rows(stored.as_of(day(n)).where("url IS NOT NULL")) == rows(versioning.as_of(whole, ntz(n)).where("url IS NOT NULL"))
    assert stored.as_of(datetime(2023, 1, 1)).count() == 0


def test_a_small_change_writes_little_and_as_of_leaves_folders_out(spark, stored):
    stored.merge(spark.createDataFrame([page(i) for i in range(400)], SCHEMA), day(1))
    first = dict(stored._manifest().open)
    stored.merge(spark.createDataFrame([page(i, "new" if i == 7 else "same") for i in range(400)], SCHEMA), day(2))
    manifest = stored._manifest()
    assert len(first) == 8 and sum(first[b] != manifest.open[b] for b in first) == 1
    assert stored._read(manifest, [manifest.closed[0][0]]).count() == 1
    stored.merge(spark.createDataFrame([page(i, "new" if i == 7 else "same") for i in range(400)], SCHEMA), day(3))
    assert stored._manifest().open == manifest.open and len(stored._manifest().closed) == 1
    assert not any("/closed/" in f for f in stored.as_of(day(2)).inputFiles())
    assert any("/closed/" in f for f in stored.as_of(day(1)).inputFiles())
    with pytest.raises(ValueError):
        stored.merge(spark.createDataFrame([page(1)], SCHEMA), day(3))


@pytest.mark.parametrize("step", ["write_text", "materialize"])
def test_a_stopped_merge_changes_nothing(spark, stored, monkeypatch, step):
    stored.merge(spark.createDataFrame([page(1), page(2)], SCHEMA), day(1))
    before = rows(stored.read())
    real = getattr(h, step)

    def stop(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(h, step, stop)
    with pytest.raises(RuntimeError):
        stored.merge(spark.createDataFrame([page(1, "x")], SCHEMA), day(2))
    monkeypatch.setattr(h, step, real)
    assert rows(stored.read()) == before and stored.loads() == 1
    stored.merge(spark.createDataFrame([page(1, "x")], SCHEMA), day(2))
    assert len(rows(stored.read())) == 3 and stored.current().count() == 1
    assert set(h.file_names(spark, f"{stored.path}/open")) == {f.split("/")[1] for m in (1, 2) for f in stored._manifest(m).open.values()}


def test_columns_that_come_later_and_empty_loads(spark, stored):
    stored.merge(spark.createDataFrame([page(1), page(2)], SCHEMA), day(1))
    stored.merge(spark.createDataFrame([(*page(1), "extra"), (*page(3), "more")], SCHEMA + ", note string"), day(2))
    assert {(r["url"], r["note"]) for r in stored.read().collect()} == {("u1", None), ("u2", None), ("u3", "more")}
    stored.merge(spark.createDataFrame([], SCHEMA), day(3))
    assert stored.current().count() == 0 and stored.read().count() == 3 and stored.as_of(day(2)).count() == 2


def test_a_first_load_is_written_where_it_is_read(spark, tmp_path):
    from pagelore.sources.history import StoredHistory

    pages = spark.range(0, 400, 1, 4).selectExpr("CAST(id AS STRING) AS url", "'s' AS section", "'t' AS title", "repeat('x', 500) AS content")
    kept = StoredHistory(spark, str(tmp_path / "h"), ["section", "title", "content"], buckets=2)
    kept.merge(pages, "2024-01-01 00:00:00.000000")
    files = list((tmp_path / "h" / "open").rglob("bucket=0/*.parquet"))
    assert len(files) == 4 and kept.read().count() == 400   # a bucket has a file of each task that read the load


@pytest.mark.parametrize("few", [0, 50_000])
def test_a_merge_of_many_changes_moves_no_text(spark, stored, monkeypatch, few):
    from pagelore.operators import sieve

    monkeypatch.setattr(sieve, "BROADCAST_ROWS", few)   # 0: every set of changes is large
    monkeypatch.setattr(sieve, "KEYS_A_PART", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written, write = [], StoredHistory._write_open

    def watch(self, manifest, rows, name, touched):
        written.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, manifest, rows, name, touched)

    monkeypatch.setattr(StoredHistory, "_write_open", watch)
    try:
        whole, rng = None, random.Random(2)
        for n in range(1, 4):
            pages = [page(i, rng.choice("ab")) for i in range(1500) if rng.random() < 0.8]
            load = spark.createDataFrame(pages + [(None, "s", "t", f"c{n}")], SCHEMA)
            stored.merge(load, day(n))
            whole = versioning.first_load(load, ntz(n), COLS) if whole is None else versioning.scd2_merge(whole, load, ntz(n), COLS)
            assert rows(stored.read().where("url IS NOT NULL")) == rows(whole.where("url IS NOT NULL"))
            assert rows(stored.current().where("url IS NULL")) == rows(stored.read().where("url IS NULL"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for plan in written for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert len(written) == 3 and not moved


def test_a_split_by_bitmaps_is_exact_though_other_keys_pass(spark, monkeypatch):
    from pagelore.operators import sieve

    monkeypatch.setattr(sieve, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(sieve, "KEYS_A_PART", 20_000)   # crowded bitmaps: almost every key passes
    keys = spark.range(0, 20_000).selectExpr("CAST(id AS INT) AS a", "CAST(id % 7 AS STRING) AS b")
    every = spark.range(0, 30_000).selectExpr("id AS a", "CAST(id % 7 AS STRING) AS b", "id * 2 AS c").unionByName(
        spark.sql("SELECT CAST(NULL AS BIGINT) AS a, '1' AS b, -1L AS c"))
    inside, outside = sieve.split(every, keys.unionByName(keys), 40_000, every, ["a", "b"])
    assert sorted(r["c"] for r in inside.collect()) == list(range(0, 40_000, 2))
    assert sorted(r["c"] for r in outside.collect()) == [-1, *range(40_000, 60_000, 2)]


@pytest.mark.parametrize("twice", [False, True])
def test_the_second_load_is_that_of_a_join_and_moves_no_text(spark, tmp_path, monkeypatch, twice):
    from pagelore.catalog import views
    from pagelore.catalog.registry import Tables
    from pagelore.operators import sieve

    monkeypatch.setattr(sieve, "BROADCAST_ROWS", 0)
    spark.range(0, 300).selectExpr("nullif(id, 250) AS doc_id", "concat('t', id) AS text", "if(id % 3 = 0, 'fr', 'en') AS lang", "'s' AS source").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.range(0, 300, 2).selectExpr("nullif(id, 200) AS doc_id", "CAST(nullif(id % 5, 4) AS INT) AS toxic", "CAST(nullif(id % 7, 6) AS INT) AS quality").unionAll(
        spark.sql("SELECT 5L, 0, 0 WHERE " + str(twice).lower() + " UNION ALL SELECT 5L, 0, 1")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.sql("SELECT 1L AS page_id, 'u' AS url, 'h' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    t = Tables(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = views.load_2(t)
        wanted = t.documents.join(t.labels, "doc_id", "left").where("coalesce(toxic, 0) = 0").selectExpr(*views.LOAD_2)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.unionByName(t.pages.selectExpr(*views.WEB)).collect()))
        assert twice or "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_bytes(frame):
    """What the shuffles of a frame move when it is run."""
    frame.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(frame._jdf.queryExecution().executedPlan())


def test_a_repeated_label_moves_the_text_of_its_document_alone(spark, tmp_path):
    import duckdb

    from check import compare
    from pagelore.catalog import views
    from pagelore.catalog.registry import Tables

    spark.range(0, 300).selectExpr("id AS doc_id", "concat(repeat('x', 4000), id) AS text", "if(id % 3 = 0, 'fr', 'en') AS lang", "'s' AS source").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.range(0, 300, 2).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS INT) AS toxic", "CAST(id % 7 AS INT) AS quality").unionAll(
        spark.sql("SELECT 4L, 0, 0 UNION ALL SELECT 6L, 1, 0 UNION ALL SELECT NULL, 1, 0 UNION ALL SELECT NULL, 1, 0")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.sql("SELECT 1L AS page_id, 'u' AS url, 'h' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 0 < shuffled_bytes(views.load_2(Tables(spark, str(tmp_path)))) < 100_000   # all texts: 1,200,000
        assert compare(spark, duck, str(tmp_path), "v5_changes_between") == ""
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
