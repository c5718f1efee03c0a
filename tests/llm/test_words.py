"""Vectorised words, rolling hashes and sliding minima against plain Python."""

import re

import numpy as np
import pyarrow as pa

from pagelore.llm import words as w
from tests.llm.conftest import awkward_rows, prose


def _lists(texts, rule):
    out = []
    for row, counts, hashes in w.word_groups(pa.array(texts, pa.string()), rule):
        assert row == len(out)
        bounds = w.starts_of(counts)
        out += [hashes[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


def test_words_equal_iff_their_text_is_equal(monkeypatch):
    texts = [t for _, t, *_ in awkward_rows()]
    plain = [(w.SPACED, lambda t: t.encode().split()), (w.SPACED_LOWER, lambda t: t.encode().lower().split()),
             (w.PLAIN_LOWER, lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()))]
    for piece in (1 << 20, 64):
        monkeypatch.setattr(w, "PIECE_BYTES", piece)
        for rule, split in plain:
            seen = {}
            for text, hashes in zip(texts, _lists(texts, rule), strict=True):
                expected = split(text or "")
                assert len(expected) == len(hashes)
                for word, hashed in zip(expected, hashes):
                    assert seen.setdefault(word, hashed) == hashed
            assert len(set(seen.values())) == len(seen)


def test_no_texts():
    assert _lists([], w.SPACED) == []
    assert _lists([None, ""], w.SPACED) == [[], []]


def test_rolling_hashes_depend_on_the_window_only():
    values = w.mix(np.array([1, 2, 3, 1, 2, 3, 4], np.uint64))
    hashes = w.rolling(values, 3)
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4
    assert len(w.rolling(values, 8)) == 0


def test_sliding_minimum():
    values = np.array([len(x) * 7 % 11 for x in prose(1, 40).split()], np.uint64)
    for width in (1, 2, 3, 6, 35, 40, 41):
        expected = [min(values[i:i + width]) for i in range(len(values) - width + 1)]
        assert w.sliding_min(values, width).tolist() == expected
