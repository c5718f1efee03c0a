"""Line dedup, substring dedup and decontamination against brute force."""

import re

import numpy as np
import pytest

from pagelore.llm import decontamination as d, lines
from pagelore.llm import substrings as s
from pagelore.llm.lines import remove_repeated_lines, repeated_spans, suffix_ranks
from tests.llm.conftest import DOCS, prose


def _lines_left(rows, least):
    """What stays of each row's lines: rows of one id and text share their place."""
    places = {}
    for doc, text in {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None and r["text"] is not None}:
        lines = text.split("\n")
        for i in range(len(lines) - least + 1):
            places.setdefault(tuple(lines[i:i + least]), []).append((doc, text, i))
    gone = set()
    for found in places.values():
        first = min(p[0] for p in found)
        texts = {p[1] for p in found if p[0] == first}
        assert len(texts) == 1   # the fixtures leave no tie between texts of one id
        keep = min(p for p in found if p[0] == first)
        for doc, text, i in found:
            if (doc, text, i) != keep:
                gone |= {(doc, text, i + k) for k in range(least)}
    out = []
    for r in rows:
        lines = [] if r["text"] is None else r["text"].split("\n")
        kept = [x for i, x in enumerate(lines) if (r["doc_id"], r["text"], i) not in gone]
        out.append((str(r["doc_id"]), None if r["text"] is None else "\n".join(kept), len(lines)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs(awkward, ready, least):
    extra = [(20, "a\nb\nc\nd\ne\nf", "", "", 0), (21, "x\na\nb\nc\nd\ne\ny", "", "", 0), (22, "b\nc\nd\ne\nf\nz\na\nb", "", "", 0)]
    frame = awkward.unionByName(ready.createDataFrame(extra, DOCS))
    got = remove_repeated_lines(frame, min_lines=least, to="left_text").collect()
    assert sorted(((str(r["doc_id"]), r["left_text"], r["n_lines"]) for r in got), key=str) == _lines_left(frame.collect(), least)
    for r in got:
        spans = [(x["start"], x["stop"]) for x in r["removed_spans"]]
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_long_single_lines(ready):
    """A passage that is one line goes between different neighbours too; a short line stays."""
    long, other, short = prose(30, 50), prose(31, 60), prose(32, 49)
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{short}"), (3, long), (4, f"{short}\n{other}\n{long}\n{other}\nz"), (5, f"y\n{other}\nz\nw"), (None, long)]
    frame = ready.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["left_text"], [tuple(x) for x in r["removed_spans"]])
           for r in remove_repeated_lines(frame, to="left_text", long_words=50).collect()}
    assert got == {1: (rows[0][1], []), 2: (f"c\nd\n{short}", [(1, 2)]), 3: ("", [(0, 1)]), 4: (f"{short}\n{other}\nz", [(2, 4)]),
                   5: ("y\nw", [(1, 3)]), None: (long, [])}


def test_ranks_follow_equal_runs(ready):
    frame = ready.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nd"), (3, "b\nc")], "doc_id long, text string")
    (span, found), = suffix_ranks(frame, min_lines=2)
    ranks = {}
    for r in found.collect():
        ranks.setdefault(r["rank"], set()).add((r["doc_id"], r["pos"], r["later"]))
    assert span == 2 and sorted(map(sorted, ranks.values())) == [[(1, 0, False), (2, 0, True)], [(1, 1, False), (3, 0, True)]]


@pytest.mark.parametrize("least, crowd", [(1, 1 << 40), (2, 4096), (3, 1)])
def test_every_round_is_the_suffix_array_to_its_depth(ready, monkeypatch, least, crowd):
    """Ranks of all rounds against sorted suffixes, with no, some and all ranks taken for hot."""
    monkeypatch.setattr(lines, "CROWD", crowd)
    rng = np.random.default_rng(5)
    texts = [["ab"[i] for i in rng.integers(0, 2, n)] for n in (1, 7, 40, 40)] + [list("abc") * 9, list("c" * 33)]
    texts.append(texts[3])
    frame = ready.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    depth = least
    for span, found in suffix_ranks(frame, min_lines=least):
        assert span == depth
        places = {}
        for i, t in enumerate(texts):
            for at in range(len(t) - span + 1):
                places.setdefault(tuple(t[at:at + span]), []).append((i, at))
        wanted = {run: p for run, p in places.items() if len(p) > 1}
        got = {}
        for r in found.collect():
            got.setdefault(r["rank"], []).append((r["doc_id"], r["pos"], r["later"]))
        assert sorted(sorted(g) for g in got.values()) == sorted([(*x, x != p[0]) for x in p] for p in wanted.values())
        depth *= 2
    assert depth == max(least, 1) * 2 ** int(np.ceil(np.log2(41 / least)))
    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in repeated_spans(frame, min_lines=least).collect()}
    assert spans[6] == [(0, 40)] and spans[5] == [(0 if least == 1 else 1, 33)]   # a c stands in text 4 too


def test_line_dedup_of_nothing_and_of_clashing_columns(empty, awkward):
    assert remove_repeated_lines(empty, to="left_text").count() == 0
    frame = awkward.selectExpr("doc_id", "text", "1 as text_key", "2 as found", "3 as doc_id_")
    got = remove_repeated_lines(frame, to="text")
    assert got.columns == [*frame.columns, "removed_spans", "n_lines"] and got.first()["found"] == 2
    clash = remove_repeated_lines(awkward.selectExpr("doc_id", "text", "7 as n_lines", "8 as removed_spans"), to="left_text")
    assert clash.columns == ["doc_id", "text", "n_lines", "removed_spans", "left_text", "removed_spans_", "n_lines_"]
    assert {(r["n_lines"], r["removed_spans"]) for r in clash.collect()} == {(7, 8)}


def _windows_left(rows, width):
    low = {}
    for r in rows:
        words = (r["text"] or "").encode().split()
        for i in range(len(words) - width + 1):
            key = tuple(words[i:i + width])
            if r["doc_id"] is not None:
                low[key] = min(low.get(key, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        words, gone = (r["text"] or "").encode().split(), set()
        for i in range(len(words) - width + 1):
            if r["doc_id"] is not None and low[tuple(words[i:i + width])] < r["doc_id"]:
                gone |= set(range(i, i + width))
        out.append((str(r["doc_id"]), b" ".join(x for i, x in enumerate(words) if i not in gone).decode(), len(words), len(gone)))
    return sorted(out)


@pytest.mark.parametrize("width", [1, 3, 20, 50])
def test_substrings(awkward, ready, width):
    shared = prose(9, 70)
    extra = [(20, prose(10, 30) + " " + shared, "", "", 0), (21, shared + " " + prose(11, 5) + " " + shared, "", "", 0), (22, "w " * 120, "", "", 0),
             (23, "w " * 60, "", "", 0)]
    frame = awkward.unionByName(ready.createDataFrame(extra, DOCS)).repartition(5)
    got = s.remove_repeats(frame, width=width).collect()
    assert sorted((str(r["doc_id"]), r["kept_text"], r["n_words"], r["n_removed"]) for r in got) == _windows_left(frame.collect(), width)
    assert all(sum(x["stop"] - x["start"] for x in r["spans"]) == r["n_removed"] for r in got)


def test_repeated_rows_give_no_more_places_than_rows(ready):
    rows = [(1, "a\nb\nc", "", "", 0)] * 60 + [(2, "a\nb\nc", "", "", 0)]
    assert [(n, r.count()) for n, r in suffix_ranks(ready.createDataFrame(rows, DOCS), min_lines=2)] == [(2, 61 * 2)]


def test_substrings_of_nothing_and_of_clashing_columns(empty, awkward):
    assert s.remove_repeats(empty).count() == 0
    frame = awkward.selectExpr("doc_id", "text", "1 as text_key", "2 as runs", "3 as runsn")
    assert s.remove_repeats(frame).first()["runs"] == 2
    clash = s.remove_repeats(awkward.selectExpr("doc_id", "text", "1 as n_words", "2 as Spans"))
    assert clash.columns == ["doc_id", "text", "n_words", "Spans", "kept_text", "n_words_", "n_removed", "spans_"]
    assert {r["n_words"] for r in clash.collect()} == {1} and clash.where("doc_id = 12").first()["n_words_"] == 80


def test_hot_deals_are_split_and_stay_whole(ready):
    """A passage shorter than a window, among ever other words, is the smallest run of many windows."""
    boiler, shared = prose(20, 24), prose(21, 40)
    texts = [prose(100 + i, 30) + " " + boiler + " " + (shared if i % 7 == 0 else prose(500 + i, 30)) for i in range(150)]
    frame = ready.createDataFrame([(i, x, "", "", 0) for i, x in enumerate(texts)], DOCS).repartition(6)
    rows = frame.selectExpr("doc_id", "xxhash64(text) text_key", "text")
    deals, parts = s.hot_deals(rows, 50, 200)
    assert len(deals) and (parts > 1).all()
    got = s.remove_repeats(frame, hot_windows=200).collect()
    assert sorted((str(r["doc_id"]), r["kept_text"], r["n_words"], r["n_removed"]) for r in got) == _windows_left(frame.collect(), 50)
    windows = np.arange(50_000, dtype=np.uint64)
    split = s._split(np.full(50_000, deals[0]), np.repeat(windows[:25_000], 2), (deals[:1], np.array([20], np.uint64)))
    assert (split[::2] == split[1::2]).all() and np.unique(split, return_counts=True)[1].max() < 50_000 / 15
    assert (s._split(windows, windows, (deals[:1], parts[:1])) == windows).all()


def test_tasks_compare_whole_deals(monkeypatch):
    monkeypatch.setattr(s, "HELD_BYTES", 500)
    deals = sorted([1] * 3 + [1_000] * 200 + [-5] * 4 + list(range(10, 90)))
    rows = [s._rows([[d], [i], [0], [0], [1], [b"1234567"]]) for i, d in enumerate(deals)]
    tables = list(s._complete(iter([rows[0].slice(0, 0), *rows])))
    assert [x for t in tables for x in t.column("doc_id").to_pylist()] == list(range(len(deals)))
    seen = [set(t.column("deal").to_pylist()) for t in tables]
    assert len(tables) > 5 and sum(map(len, seen)) == len(set(deals))


ITEMS = [(1, prose(2, 80)), (2, prose(9, 12)), (10, "one"), (3, None), (4, ""), (5, " ., "), (None, prose(3, 40)), (6, prose(9, 12)), (6, "x y z"), (7, prose(1, 30_000)[-400:])]


def _hits(text, items, width=10):
    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    mine, hit, ids = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        if name is None or not theirs:
            continue
        size = min(width, len(theirs))
        windows = {tuple(theirs[i:i + size]) for i in range(len(theirs) - size + 1)}
        for i in range(len(mine) - size + 1):
            if tuple(mine[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(str(name))
    return len(mine), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination(awkward, ready, block):
    bench = ready.createDataFrame(ITEMS, "item_id long, text string")
    extra = [(30, prose(9, 12)[:-3] + " " + prose(9, 12).upper().replace(" ", "-"), "", "", 0), (31, "X, y; Z!", "", "", 0)]
    frame = awkward.unionByName(ready.createDataFrame(extra, DOCS))
    got = d.contamination(frame, bench, block_windows=block).withColumn("n_hit", d.hit_words()).collect()
    assert len(got) == frame.count()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == _hits(r["text"], ITEMS), r["doc_id"]


def test_decontamination_of_nothing(empty, awkward, ready):
    none = ready.createDataFrame([], "item_id long, text string")
    assert d.contamination(empty, none).count() == 0
    clash = d.contamination(awkward.selectExpr("doc_id", "text", "5 as n_words", "6 as ITEM_IDS"), none)
    assert clash.columns == ["doc_id", "text", "n_words", "ITEM_IDS", "n_words_", "hit_spans", "item_ids_"]
    assert {(r["n_words"], r["ITEM_IDS"]) for r in clash.collect()} == {(5, 6)}
    assert d.drop_contaminated(awkward, none).count() == awkward.count()
    frame = awkward.selectExpr("doc_id", "text", "1 as hit_spans", "2 as n_words")
    left = d.drop_contaminated(frame, ready.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert left.columns == frame.columns and {0, 1, 12}.isdisjoint(r["doc_id"] for r in left.collect())
