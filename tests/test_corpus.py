"""Chunking, link index, page history and sources on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from pagelore.operators import chunking, linkindex, versioning
from pagelore.operators.ranking import row_ids
from pagelore.sources import landing, questions, tables

PAGE = "\n".join([
    "intro", "# One", "text 1", "### Deep", "deep text", "```", "# not a heading", "```", "## Two", "", "  ",
    "#### Four", "four", "## Three", "three", "##### five is text", "# Last", "end"])


def sections_of(spark, content):
    pages = spark.createDataFrame([("u", content)], "url string, content string")
    rows = chunking.split_sections(pages).orderBy("section_id").collect()
    return [(r["heading_path"], r["text"]) for r in rows]


def test_sections_follow_the_heading_trail(spark):
    assert sections_of(spark, PAGE) == [
        ("", "intro"), ("One", "text 1"), ("One > Deep", "deep text\n```\n# not a heading\n```"),
        ("One > Two > Four", "four"), ("One > Three", "three\n##### five is text"), ("Last", "end")]


def test_page_without_headings_is_one_section(spark):
    assert sections_of(spark, "a\r\nb\n") == [("", "a\nb")]


def test_chunks_keep_page_columns_and_bounds(spark):
    body = "\n\n".join(f"paragraph {i} " + "x" * 150 for i in range(40))
    pages = spark.createDataFrame(
        [("u1", "T1", f"# A\n{body}\n# B\nshort"), ("u2", None, "tiny"), ("u3", "T3", "")],
        "url string, title string, content string")
    rows = chunking.chunk_pages(pages, keep=["title"]).orderBy("url", "chunk_index").collect()
    big = [r for r in rows if r["url"] == "u1"]
    assert [r["chunk_index"] for r in big] == list(range(len(big)))
    assert all(r["title"] == "T1" and len(r["content"]) >= 200 for r in big)
    assert big[-1]["content"].endswith("short")
    assert [(r["url"], r["heading_path"], r["content"]) for r in rows if r["url"] != "u1"] == [("u2", "", "tiny")]


INDEX = "\n".join([
    "# Site", "preamble prose", "- [Early](https://docs.example.com/early.md)",
    "## Payments", "All about payments.", "- [Pay](https://docs.example.com/pay.md): how to pay ",
    "- [Help](https://support.example.com/help.md)", "- [Raw](https://docs.example.com/raw)", "Second line.",
    "## Instructions for Large Language Model Agents", "Prefer this.", "", "- [X](https://docs.example.com/x.md)",
    "## Billing", "- [Pay again](https://docs.example.com/pay.md): twice", "- [Bill](https://docs.example.com/bill.md):"])


def test_link_index(spark):
    docs = spark.createDataFrame([(1, INDEX)], "doc_id long, text string")
    links = linkindex.link_index(docs, "docs.example.com").orderBy("position").collect()
    assert [tuple(r)[1:] for r in links] == [
        ("", "Early", "https://docs.example.com/early.md", None, 0),
        ("Payments", "Pay", "https://docs.example.com/pay.md", "how to pay", 1),
        ("Billing", "Bill", "https://docs.example.com/bill.md", None, 2)]
    lines = linkindex.index_lines(docs)
    assert [tuple(r)[1:] for r in linkindex.sections(lines).orderBy("position").collect()] == [
        ("Payments", "All about payments.\nSecond line.", 0), ("Billing", None, 1)]
    assert linkindex.guidance_text(lines).first()["guidance"] == (
        "Prefer this.\n\n- [X](https://docs.example.com/x.md)")
    guide = versioning.guidance_row(linkindex.guidance_text(lines), "https://docs.example.com/i.txt", "d").first()
    assert guide["page_type"] == "llm_guidance" and guide["url"].startswith("https://docs.example.com/i.txt#")


COLS = ["section", "title", "content"]
SCHEMA = "url string, section string, title string, content string"


def load(spark, *rows):
    return spark.createDataFrame([(u, "s", title, body) for u, title, body in rows], SCHEMA)


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")


def state(history):
    return sorted((r["url"], r["title"], r["content"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day)
                  for r in history.collect())


def test_history(spark):
    first = versioning.first_load(load(spark, ("a", "A", "1"), ("b", "B", "1"), ("c", "C", "1")), at(1), COLS)
    second = versioning.scd2_merge(first, load(spark, ("a", "A", "1"), ("b", "B2", "1"), ("d", "D", "1")), at(2), COLS)
    assert state(second) == [
        ("a", "A", "1", 1, None), ("b", "B", "1", 1, 2), ("b", "B2", "1", 2, None), ("c", "C", "1", 1, 2),
        ("d", "D", "1", 2, None)]
    # a returned page opens again; the same load twice changes nothing
    third = versioning.scd2_merge(second, load(spark, ("a", "A", "1"), ("c", "C", "1")), at(3), COLS)
    assert [r for r in state(third) if r[0] == "c"] == [("c", "C", "1", 1, 2), ("c", "C", "1", 3, None)]
    again = versioning.scd2_merge(third, load(spark, ("a", "A", "1"), ("c", "C", "1")), at(4), COLS)
    assert state(again) == state(third)
    assert versioning.read_current_pages(third).groupBy("url").count().where("count > 1").count() == 0
    assert sorted(r["url"] for r in versioning.as_of(third, at(2)).collect()) == ["a", "b", "d"]
    changes = {r["url"]: r["change"] for r in versioning.changes_between(third, at(1), at(3)).collect()}
    assert changes == {"b": "retired"}


def test_failed_fetch_aborts_the_load(spark):
    schema = "url string, final_url string, status int, content string"
    fine = [("https://d.x/a", "https://d.x/a", 200, "1"), ("https://d.x/b", "https://d.x/b", 404, ""),
            ("https://d.x/c", "https://other.x/c", 500, "")]
    assert [r["url"] for r in versioning.fetched_pages(spark.createDataFrame(fine, schema)).collect()] == ["https://d.x/a"]
    with pytest.raises(Exception, match="load aborted"):
        versioning.fetched_pages(
            spark.createDataFrame(fine + [("https://d.x/d", "https://d.x/d", 503, "")], schema)).collect()


def test_row_ids_are_consecutive(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("page"), F.col("id").alias("n")).repartition(5)
    got = row_ids(rows, ["page", "n"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 1001))
    assert [(r["page"], r["n"]) for r in got] == sorted((r["page"], r["n"]) for r in got)


def test_question_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"question": "é?", "source": "s", "answer_page_url": "u"}\n\n{"question": "q", "source": ""}\nnope\n',
                    encoding="utf-8")
    good, rejects = questions.read_questions(spark, str(path))
    assert [r["question"] for r in good.collect()] == ["é?"]
    assert [(r["lineno"], r["problem"]) for r in rejects.orderBy("lineno").collect()] == [
        (3, "missing source, answer_page_url"), (4, "not JSON")]
    with pytest.raises(ValueError, match=":3 missing source"):
        questions.require_questions(good, rejects)
    with pytest.raises(ValueError, match="empty"):
        questions.require_questions(good.limit(0), rejects.limit(0))
    questions.write_questions(good, str(tmp_path / "out"))
    assert "é?" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))


def test_raw_files_and_history_table(spark, tmp_path):
    (tmp_path / "raw" / "a").mkdir(parents=True)
    (tmp_path / "raw" / "a" / "x.md").write_text("one\ntwo\n")
    (tmp_path / "raw" / "index.txt").write_text("i")
    assert sorted(r["content"] for r in landing.read_raw_pages(spark, str(tmp_path / "raw")).collect()) == ["i", "one\ntwo\n"]
    first = versioning.first_load(load(spark, ("a", "A", "1"), ("b", "B", "1")), at(1), COLS)
    tables.write_history(versioning.scd2_merge(first, load(spark, ("a", "A", "1")), at(2), COLS), str(tmp_path / "h"))
    current = tables.read_current(spark, str(tmp_path / "h"))
    assert [r["url"] for r in current.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(is_current" in current._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_where_they_are_when_few_pages_change(spark):
    pages = spark.range(3000).selectExpr("concat('u', id) as url", "'s' as section", "repeat(cast(id as string), 60) as content")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    history = versioning.first_load(pages, at, ["content"])
    load = pages.where("url <> 'u7'").withColumn("content", F.expr("if(url = 'u9', 'new', content)"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        merged = versioning.scd2_merge(history, load, at, ["content"])
        assert merged.where("valid_to is not null").count() == 2 and merged.count() == 3001
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_headings_in_one_index_take_linear_time(spark):
    import time

    text = "\n".join(f"## h{i}\n- [t{i}](https://h/{i}.md): d" for i in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "intro\r\n## a\rx\n##  \n## b")], "doc_id long, text string")
    linkindex.index_lines(docs.where("doc_id > 1")).count()
    start = time.time()
    rows = linkindex.index_lines(docs).where("doc_id = 1").agg({"section_pos": "max", "pos": "max"}).first()
    assert time.time() - start < 5 and sorted(rows) == [19_998, 19_999]
    got = [(r["pos"], r["line"], r["is_heading"], r["section"], r["section_pos"])
           for r in linkindex.index_lines(docs).where("doc_id = 4").orderBy("pos").collect()]
    assert got == [(0, "intro", False, "", None), (1, "## a", True, "a", 1), (2, "x", False, "a", 1), (3, "##  ", True, "", 3), (4, "## b", True, "b", 4)]


def test_pages_land_in_packs(spark, tmp_path):
    rows = [(f"u{i % 280}", "é\n" * (i % 7) + f"text {i % 290}\r\n") for i in range(300)] + [("none", None), ("empty", ""), ("long", "x" * 5_000)]
    pages = spark.createDataFrame(rows + rows[:1], "url string, content string").repartition(5)
    where = str(tmp_path / "landed")
    landing.write_page_packs(pages, where, pack_bytes=1_000)
    got = landing.read_page_packs(spark, where)
    assert sorted(map(str, got.collect())) == sorted(map(str, pages.collect()))
    files = list((tmp_path / "landed" / "packs").rglob("part-*"))
    total = sum(f.stat().st_size for f in files)
    assert len(files) <= 2 * total / 1_000 + 2
    assert sorted(f.stat().st_size for f in files)[-2] < 1_000 + 60
    some = landing.read_page_packs(spark, where, wanted=F.col("url").isin("u3", "none"))
    assert sorted(map(str, some.collect())) == sorted(str(r) for r in pages.collect() if r["url"] in ("u3", "none"))
    nothing = str(tmp_path / "nothing")
    landing.write_page_packs(pages.limit(0), nothing)
    assert landing.read_page_packs(spark, nothing).count() == 0


def test_a_pack_is_not_copied_for_each_of_its_pages(spark, tmp_path):
    import time

    pages = spark.range(40_000).selectExpr("concat('u', id) AS url", "concat(id, repeat('x', 390)) AS content")
    landing.write_page_packs(pages, str(tmp_path / "landed"))
    start = time.time()
    assert landing.read_page_packs(spark, str(tmp_path / "landed")).agg({"content": "max", "url": "count"}).first()["count(url)"] == 40_000
    assert time.time() - start < 8


def test_raw_pages_land_in_few_files(spark, tmp_path, monkeypatch):
    from pagelore.catalog import corpus
    from pagelore.catalog.registry import Tables

    monkeypatch.setattr(corpus, "new_path", lambda spark, name: str(tmp_path / name))
    rows = corpus.s1(Tables(spark, "/root/testdata/sf0.001"))
    assert rows.count() > 20 > len(list((tmp_path / "landed").rglob("part-*")))
