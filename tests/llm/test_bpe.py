import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagelore.llm import bpe
from pagelore.llm.queries import TOKENIZERS
from tests.llm.conftest import awkward_rows

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def _same(library, own, texts):
    for text, ids in zip(texts, own.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text[:80]
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_random_texts_are_encoded_as_by_the_library(library, own):
    rng = random.Random(1)
    pool = [*"abÀéÉ ΣσςİIı'’1２Ⅷ  \t\ń \x1c\x85中文😀🇩🇪!?-ﬁßẞẛ̣aaaaeeee", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "the", "ing"]
    _same(library, own, ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)])


def test_every_character_is_encoded_as_by_the_library(library, own):
    known = [chr(c) for c in range(0x34000) if not 0xD800 <= c < 0xE000]   # no letters beyond
    _same(library, own, ["".join(f"a{c}1 {c}b" for c in known[i:i + 512]) for i in range(0, len(known), 512)])


def test_long_texts_in_parts_and_a_small_memory(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 64)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    _same(library, own, [t or "" for _, t, *_ in awkward_rows()] + ["é " * 40 + "Σ" * 200])


def test_no_encoding_crosses_a_forced_cut(own):
    word = "zqéxç漢jß"
    raw = word.encode()
    cuts = [i + 1 for i, (a, b) in enumerate(zip(raw, raw[1:])) if not own.joined[a, b]]
    assert cuts
    lengths = np.cumsum([len(own.tokens[i].removesuffix(own.suffix)) for i in np.frombuffer(own.encode([word])[0], "<u4")])
    assert set(cuts) <= set(lengths.tolist())


def test_frames(awkward, empty, library):
    out = bpe.decode(bpe.encode(awkward, PATH), PATH).withColumn("n", bpe.token_count()).collect()
    assert len(out) == awkward.count()
    for row in out:
        wanted = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert hashlib.sha256(row["ids"]).digest() == hashlib.sha256(np.array(wanted, "<u4").tobytes()).digest()
        assert row["n"] == len(wanted) and row["decoded"] == library.decode(wanted, skip_special_tokens=False)
    assert bpe.encode(empty, PATH).count() == 0
    assert bpe.encode(awkward.selectExpr("text", "1 as made"), PATH).columns == ["text", "made", "ids"]
    clash = bpe.encode(awkward.selectExpr("text", "1 as IDS"), PATH)
    assert clash.columns == ["text", "IDS", "ids_"] and clash.first()["IDS"] == 1
