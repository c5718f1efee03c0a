"""Embedding near-duplicates and WARC fixity against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.llm import embeddings as e
from pagelore.llm import warc
from pagelore.session import new_path

VECTORS = "vec_id long, embedding array<float>, label int"


def _rows():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 6)):
                rows.append((n, (centre + rng.standard_normal(16) * rng.choice([0.02, 0.25])).tolist(), label))
                n += 1
    v = rows[0][1]
    rows += [(100, v, 0), (101, v, 0), (101, v, 0), (102, v, 1), (103, v, None), (104, None, 0), (105, [0.0] * 16, 0), (106, [], 0),
             (107, [float("nan")] + v[1:], 0), (108, [float("inf")] + v[1:], 0), (109, [None] + v[1:], 0), (110, v[:8], 0),
             (None, v, 0), (111, [x * 1e-30 for x in v], 0), (112, [-0.0, 1.0], 0), (113, [0.0, 1.0], 0)]
    return rows


def _brute(rows, cosine):
    unit = []
    for _, v, label in rows:
        v32 = None if not v or any(x is None for x in v) else np.array(v, np.float32).astype(float)
        unit.append(None if v32 is None or label is None or not np.isfinite(v32).all() or not v32.any() else v32 / np.linalg.norm(v32))
    near = [[j for j in range(len(rows)) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    low = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    return sorted((str(rows[i][0]), len(near[i]), str(low[label[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("tile, cosine", [(4096, 0.93), (5, 0.93), (5, 0.4)])
def test_near_vectors(ready, tile, cosine):
    rows = _rows()
    got = e.near_vectors(ready.createDataFrame(rows, VECTORS), tile=tile, cosine=cosine).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == _brute(rows, cosine)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 24)) * rng.exponential(1, 24)
    tile = e._Tile(np.arange(300), vectors, np.ones(300))
    near = (tile.whole.astype(float) @ tile.whole.T.astype(float)) * tile.scale[:, None] * tile.scale
    bound = tile.error[:, None] + (1 + tile.error[:, None]) * tile.error
    assert (np.abs(near - tile.unit @ tile.unit.T) <= bound).all()


def test_no_vectors_and_clashing_columns(ready):
    assert e.near_vectors(ready.createDataFrame([], VECTORS)).count() == 0
    frame = ready.createDataFrame(_rows()[:6], VECTORS).selectExpr("*", "1 as node", "2 as n_links", "3 as size")
    assert e.near_vectors(frame).count() == 6


PAGES = "page_id long, url string, html string"
HTML = [(1, "http://a/", "<p>one</p>"), (2, None, "é" * 5000), (3, "http://b/", None), (4, "http://c/x y\r\nEvil: 1", ""), (5, "u", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\nx"),
        (None, "n", "none"), (7, "u", "x" * 3_000_000), (9, "same", "same"), (9, "same", "same"), (9, "other", "text")]


def _pages(ready):
    return ready.createDataFrame(HTML + [(i, f"http://d/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(20, 90)], PAGES)


def test_intact_replicas_agree(ready):
    pages = _pages(ready)
    got = warc.fixity_check(pages, new_path(ready, "warc"), per_file=8).collect()
    assert len(got) == pages.count() and all(r["intact"] for r in got)
    by_file = {}
    for r in got:
        by_file.setdefault((r["archive"], r["part"]), []).append(r)
    for rows in by_file.values():
        rows.sort(key=lambda r: r["ordinal"])
        assert rows[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(rows, rows[1:]))
    records = {hashlib.sha256(r["value"].encode() + b"\r\n\r\n").hexdigest() for r in warc.archived(pages, per_file=8).collect()}
    assert {r["sha256"] for r in got} == records
    assert warc.fixity_check(ready.createDataFrame([], PAGES), new_path(ready, "warc")).count() == 0


def test_damage_is_located(ready):
    pages = _pages(ready)
    got = warc.fixity_check(pages, new_path(ready, "warc"), F.col("page_id").isin(1, 2, 3, 7, 33, 34), per_file=8).collect()
    assert {r["record_id"] for r in got if not r["intact"]} == {f"<urn:page:{i}>" for i in (1, 2, 7, 33, 34)}


def test_lost_and_added_records_are_found(ready):
    leaves = warc.read_warc(ready, _written(ready, _pages(ready)))
    fewer = leaves.where("archive <> 3 and not (archive = 5 and ordinal >= 2)")
    lost = leaves.join(fewer, ["archive", "part", "ordinal"], "left_anti").count()
    gone = warc.audit(leaves, fewer).collect()
    assert lost and len(gone) == lost and all(r["second_sha256"] is None and r["start"] is not None for r in gone)
    assert len(warc.audit(fewer, leaves).collect()) == lost and warc.audit(leaves, leaves).count() == 0


def _written(ready, pages):
    path = new_path(ready, "warc")
    warc.write_warc(warc.archived(pages, per_file=8), path)
    return path


def test_records_of_damaged_streams():
    record = b"WARC/1.1\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = record * 4
    assert [r for _, r in warc.split_records(iter([whole]))] == [record] * 4
    assert [r for _, r in warc.split_records(iter([whole[i:i + 7] for i in range(0, len(whole), 7)]))] == [record] * 4
    longer = record.replace(b"abc", b"abcd") + record + record.replace(b": 3", b": x") + record
    found = list(warc.split_records(iter([longer])))
    assert b"".join(r for _, r in found) == longer and [r for _, r in found][1] == record and [r for _, r in found][3] == record
    assert list(warc.split_records(iter([]))) == [] and list(warc.split_records(iter([b"junk"]))) == [(0, b"junk")]
    assert b"".join(warc.inflated(b"\x1f\x8bbroken")) == b""


def test_parts_of_an_archive_do_not_depend_on_the_table(ready):
    crowd = ready.range(40).selectExpr("3L as page_id", "concat('u', id) as url", "'x' as html")
    more = crowd.unionByName(ready.range(8, 800).selectExpr("id as page_id", "'u' as url", "'y' as html"))
    alone, among = (warc.archived(x, per_file=8).where("archive = 0") for x in (crowd, more))
    assert sorted(map(str, alone.collect())) == sorted(map(str, among.collect()))
    assert among.select("part").distinct().count() == 5
