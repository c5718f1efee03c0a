import numpy as np
import pytest
import xxhash

from pagelore.llm import simhash as s
from pagelore.llm.components import components


def _plain(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(values, bits=4):
    values = np.array(values, np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    rows, places, homes = s.anchors(x)
    mine = {(r, p) for r, p, h in zip(rows, places, homes) if h}
    rows, places, homes = s.anchors(y)
    theirs = {(r, p) for r, p, h in zip(rows, places, homes) if not h}
    assert {r for r, _ in mine & theirs} == set(range(len(x)))


def test_groups_of_awkward_rows(awkward):
    got = s.simhash_groups(awkward).collect()
    rows = awkward.collect()
    prints = [_plain(r["text"]) for r in rows]
    label = _classes(prints)
    low = {k: min((r["doc_id"] for r, x in zip(rows, label) if x == k and r["doc_id"] is not None), default=None) for k in set(label)}
    expected = sorted((str(r["doc_id"]), p, str(low[x])) for r, p, x in zip(rows, prints, label))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == expected


def test_crowded_anchors_are_cut_into_cells(ready, monkeypatch):
    monkeypatch.setattr(s, "CELL_HOMES", 3)
    monkeypatch.setattr(s, "HOT_ANCHORS", 1 << 40)
    values = [0b1111 << i for i in range(0, 56, 2)] + [0, 1 << 63]
    frame = ready.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(s.links(frame)).collect()}
    label = _classes(values)
    groups = {}
    for v, x in zip(values, label):
        groups.setdefault(x, set()).add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_one_document_of_each_class_stays(awkward, empty):
    kept = s.drop_near_copies(awkward).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(None) == 3 and ids.count(5) == 1 and 6 not in ids and ids.count(2) == 1 and 3 not in ids
    assert sorted(r["text"] for r in kept if r["doc_id"] == 8) in (["one"], ["two words"], ["one", "two words"])
    assert s.drop_near_copies(empty).count() == 0


def test_clashing_columns_stay(awkward):
    frame = awkward.selectExpr("doc_id", "text", "1 as fp", "2 as text_key", "3 as copy_no", "4 as fingerprint")
    kept = s.drop_near_copies(frame)
    assert kept.columns == frame.columns and kept.first()["copy_no"] == 3
    assert set(s.fingerprints(frame.drop("fp"), to="fp").columns) == {"doc_id", "text_key", "copy_no", "fingerprint", "fp"}


def test_more_bits_than_the_parts_cover_are_refused(ready):
    with pytest.raises(ValueError):
        s.links(ready.createDataFrame([(1,)], "fp long"), 5)


def test_components_of_a_chain_and_a_star(ready):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(ready.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[201] == 200
    assert components(ready.createDataFrame([], "u long, v long")).count() == 0
