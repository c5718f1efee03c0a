import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagelore.llm import alignment
from pagelore.llm.queries import QUERIES, TOKENIZERS
from tests.llm.conftest import awkward_rows

FILES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
ZERO = (0, 0, 0, "", [])


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*FILES)


def brute(pair, text):
    """Groups and linked pairs of one whole text, from both libraries' tokens of all of it."""
    if not text:
        return ZERO
    raw = (" " + text).encode()
    sides = []
    for ids, entries in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes), (pair.b.encode(text), pair.b_bytes)):
        if b"".join(entries[i] for i in ids) != raw:
            return ZERO
        sides.append((ids, np.cumsum([len(entries[i]) for i in ids]).tolist()))
    (a, a_ends), (b, b_ends) = sides
    groups, links, low = [], [], 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut) for ids, ends in sides))
        links.append((a[a_ends.index(cut)], b[b_ends.index(cut)]))
        low = cut
    return len(a), len(b), len(groups), ";".join(groups), links


def plain(pair, row):
    return (*row[:4], [(int(pair.keys[n] >> 32), int(pair.keys[n] & 0xFFFFFFFF)) for n in np.frombuffer(row[4], "<u4")])


def test_random_texts_align_as_whole_texts_do(pair):
    rng = random.Random(1)
    pool = [*"abÀéΣ'’1２  \t\ń \x1c\x85　中文😀!?-ﬁ\0", "<|endoftext|>", "<s>", "<0x41>", "▁", "don't", " the", "ing", " tokens", "    "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    assert any("▁" in t for t in texts)
    for text, row in zip(texts, pair.texts(texts), strict=True):
        assert plain(pair, row) == brute(pair, text), text


def test_a_small_memory_and_small_blocks(pair, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    monkeypatch.setattr(alignment, "REMEMBERED_CHARS", 5)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 64)
    texts = [(t or "")[:3000] for _, t, *_ in awkward_rows()] + ["x▁y " * 40, "é" * 500]
    for text, row in zip(texts, pair.texts(texts) + pair.texts(texts)[:1]):
        assert plain(pair, row) == brute(pair, text)


def test_a_piece_that_goes_on_after_a_space_is_refused(pair, monkeypatch):
    monkeypatch.setattr(alignment.Pair, "_piece", lambda self, i: b"a b")
    with pytest.raises(ValueError):
        alignment.Pair(*FILES)


def test_frames(awkward, empty, pair, tmp_path):
    given = awkward.selectExpr("doc_id", "text", "lang AS n_a", "1 AS alignment", "2 AS made")
    out = alignment.align(given, *FILES).collect()
    assert sorted(map(str, [r["doc_id"] for r in out])) == sorted(str(i) for i, *_ in awkward_rows())
    assert {r["n_a"] for r in out} == {"en"} and {r["made"] for r in out} == {2}
    for row in out:
        if len(row["text"] or "") < 5000:
            assert plain(pair, row["alignment"]) == brute(pair, row["text"] or "")
    long = [r["alignment"] for r in out if r["doc_id"] in (5, 6)]
    assert long[0] == long[1] and long[0]["n_a"] > 30_000
    assert alignment.align(empty, *FILES).count() == 0


def test_the_query_counts_links_over_all_documents(ready, awkward, empty, pair, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op11_token_alignment"](ready, str(tmp_path)).collect()), key=str)
    rows = {t: plain(pair, pair.texts([t or ""])[0]) for _, t, *_ in awkward_rows()}
    counts = Counter(x for _, t, *_ in awkward_rows() for x in rows[t][4])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    wanted = []
    for doc_id, text, *_ in awkward_rows():
        n_a, n_b, n_groups, groups, links = rows[text]
        wanted.append((doc_id, n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "",
                       sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)))
    assert got == sorted(wanted, key=str)
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op11_token_alignment"](ready, str(tmp_path / "none")).count() == 0
