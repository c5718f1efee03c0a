"""Byte-pair encoding with forced cuts, and decoding.

A merge can only join two bytes that stand next to each other in some token. Where a
pair of neighbouring bytes occurs in no token of the vocabulary, every encoding has a
cut there. Words are split at those forced cuts, the fragments are encoded on their own,
side by side in arrays, and their ids are concatenated. Words seen before are remembered.

The vocabulary is a JSON file as the tokenizers library writes it: NFC, lower case and
white space in the normalizer, one splitting pattern, byte-level symbols, an end-of-word
suffix. Character properties are those of the interpreter's Unicode version.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.tables import spare
from pagelore.llm.words import BASE

PIECE_CHARS = 1 << 20
OUT_ROWS = 128
#: Words that each of a worker's two memories holds.
REMEMBERED = 60_000
WORDS_AT_ONCE, BLOCK = 1 << 16, 1 << 15
NO_RANK = np.iinfo(np.int32).max
# Capital letters that Unicode got after version 15.1, and their small letters.
LATER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},   # Garay
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},   # Beria Erfe
}
# First and last of the letters that came with Unicode 16, the version whose letters make words.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)


def later_letters() -> frozenset[str]:
    """What the pattern library takes for a letter and Unicode 16 does not."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = {c for c in regex.findall(r"\p{L}", every) if unicodedata.category(c) == "Cn"}
    return frozenset(new.difference(chr(c) for first, last in LETTERS_16 for c in range(first, last + 1)))


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare_ = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare_)
            spare_ += 1
    return [out[b] for b in range(256)]


class _PairTable:
    """Rank of a pair of ids, for many pairs at a time: one hashed slot, and a search where two keys share it."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        slots = self._slots(self.keys)
        self.table = np.full(1 << self.BITS, len(keys), np.int32)
        self.table[slots] = np.arange(len(keys), dtype=np.int32)
        self.shared = np.bincount(slots, minlength=1 << self.BITS) > 1
        self.keys = np.append(self.keys, np.int64(-1))
        self.ranks = np.append(self.ranks, np.int32(NO_RANK))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self._slots(keys)
        at = self.table[slots]
        found = self.keys[at] == keys
        ranks = np.where(found, self.ranks[at], np.int32(NO_RANK))
        again = np.flatnonzero(~found & self.shared[slots])
        if len(again):
            at = np.searchsorted(self.keys[:-1], keys[again])
            ranks[again] = np.where(self.keys[at] == keys[again], self.ranks[at], np.int32(NO_RANK))
        return ranks


class Vocabulary:
    """What encoding and decoding need, from the text of a tokenizer's JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.suffix = model["end_of_word_suffix"]
        ids = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.later = later_letters()
        self.as_symbols = dict.fromkeys(map(ord, self.later), "\uE000")
        symbols = byte_symbols()
        self.first = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + self.suffix] for s in symbols], np.int64)
        self.ranks = _PairTable(np.array([ids[a] << 32 | ids[b] for a, b in model["merges"]], np.int64))
        self.made = np.array([ids[a + b] for a, b in model["merges"]], np.int64)
        self.tokens = {i: t for t, i in (ids | special).items()}
        self.joined = self._adjacent(ids, {s: b for b, s in enumerate(symbols)})
        self.encoded: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _adjacent(self, ids: dict[str, int], byte: dict[str, int]) -> np.ndarray:
        """Whether two bytes are next to each other inside some token."""
        joined = np.zeros((256, 256), bool)
        for token in ids:
            if token.endswith(self.suffix):
                token = token[:-len(self.suffix)]
            codes = [byte[c] for c in token if c in byte]
            joined[codes[:-1], codes[1:]] = True
        return joined

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of every word. All fragments between forced cuts are merged side by side:
        in each step every fragment makes its merge of lowest rank, leftmost first."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        result = self.first[data]
        result[ends - 1] = self.last[data[ends - 1]]
        inner = np.append(self.joined[data[:-1], data[1:]], False)   # no forced cut after this byte
        inner[ends - 1] = False
        at, ids, rank = np.arange(len(data)), result.copy(), np.full(len(data), NO_RANK, np.int32)
        where = np.flatnonzero(inner)
        rank[where] = self.ranks(ids[where], ids[where + 1])
        while True:
            firsts = np.flatnonzero(np.append(True, ~inner[:-1]))
            sizes = np.diff(np.append(firsts, len(ids)))
            best = np.minimum.reduceat(rank, firsts)
            going = best < NO_RANK
            if not going.all():   # what has no merge left is done
                keep = np.repeat(going, sizes)
                if not keep.any():
                    break
                at, ids, rank, inner = at[keep], ids[keep], rank[keep], inner[keep]
                best, sizes = best[going], sizes[going]
            hit = rank == np.repeat(best, sizes)
            if (hit[1:] & hit[:-1]).any():   # a a a: every other pair of a run
                runs = np.flatnonzero(np.diff(np.append(False, hit).astype(np.int8)) == 1)
                place = np.arange(len(hit))
                hit &= (place - runs[np.maximum(np.searchsorted(runs, place, "right") - 1, 0)]) % 2 == 0
            left = np.flatnonzero(hit)
            ids[left] = self.made[rank[left]]
            result[at[left]], result[at[left + 1]] = ids[left], -1
            inner[left] = inner[left + 1]
            keep = np.ones(len(ids), bool)
            keep[left + 1] = False
            at, ids, rank, inner = at[keep], ids[keep], rank[keep], inner[keep]
            left -= np.arange(len(left))
            near = np.zeros(len(ids), bool)
            near[left] = near[np.maximum(left - 1, 0)] = True
            fresh = np.flatnonzero(near)
            rank[fresh] = NO_RANK
            fresh = fresh[inner[fresh]]
            rank[fresh] = self.ranks(ids[fresh], ids[fresh + 1])
        alive = result >= 0
        packed = result[alive].astype("<u4").tobytes()
        bounds = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    def lookup(self, words: list[str]) -> dict[str, bytes]:
        """The memory of encoded words, filled for all of ``words``. A full memory becomes the
        older one; what is met again moves on from there, so common words are never lost."""
        distinct = set(words)
        if len(self.encoded) + len(distinct) > REMEMBERED:
            self.older, self.encoded = self.encoded, {}
        new = distinct.difference(self.encoded)
        known = new.intersection(self.older)
        self.encoded.update((w, self.older[w]) for w in known)
        new = list(new.difference(known))
        for i in range(0, len(new), BLOCK):
            block = new[i:i + BLOCK]
            self.encoded.update(zip(block, self.merge(block)))
        return self.encoded

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() has another letter for it at the end of a word
                text = text.replace("Σ", "σ")
            text = text.translate(LATER_CAPITALS)
        return text.lower()

    def split(self, text: str) -> list[str]:
        """The words of a stretch. Letters too new to join words are symbols where it is split."""
        if text.isascii() or self.later.isdisjoint(text):
            return self.words.findall(text)
        return [text[m.start():m.end()] for m in self.words.finditer(text.translate(self.as_symbols))]

    def pieces(self, text: str) -> Iterator[str | list[str]]:
        """A special string, or the words of a stretch between them. Long stretches are taken in
        parts that begin at a space, where neither a word nor a composed letter can join."""
        for stretch in self.special_pattern.split(text) if "<|" in text else (text,):
            if stretch in self.special:
                yield stretch
                continue
            at = 0
            while at < len(stretch):
                end = stretch.find(" ", at + PIECE_CHARS)
                end = len(stretch) if end < 0 else end
                yield self.split(self.normal(stretch[at:end]))
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []

        def settle():
            known = self.lookup([w for _, words in waiting for w in words]).__getitem__
            for i, words in waiting:
                out[i].append(b"".join(map(known, words)))
            waiting.clear()

        size = 0
        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                if isinstance(piece, str):
                    settle()
                    out[i].append(self.special[piece])
                    continue
                waiting.append((i, piece))
                size += len(piece)
                if size >= WORDS_AT_ONCE:
                    settle()
                    size = 0
        settle()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids``, one space between, as there is no decoder in the file."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(key: str, source) -> Vocabulary:
    if key not in _loaded:
        _loaded[key] = Vocabulary(source.value)
    return _loaded[key]


def read_vocabulary(path: str) -> str:
    """The tokenizer file, read on the driver and sent to the workers (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _mapped(docs: DataFrame, column: str, to: str, kind: str, work) -> DataFrame:
    """``docs`` with ``work`` of ``column`` as ``to``, a few rows at a time."""
    names = docs.columns
    hidden = spare(docs, "made")
    at = names.index(column)
    arrow = {"binary": pa.binary(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = work()
        for batch in batches:
            for row in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(row, OUT_ROWS)
                made = many(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], names=[*names, hidden])

    schema = docs.select("*", F.lit(None).cast(kind).alias(hidden)).schema
    out = docs.mapInArrow(run, schema)
    return out.withColumnRenamed(hidden, to) if to != hidden else out


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in ``to``: little-endian unsigned 32-bit integers.

    Null texts are encoded as empty ones; the tokens of special strings in a text are
    theirs; other columns stay. If there is a column ``to`` already, the new one gets underscores.
    """
    to = spare(docs, to)
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def work():
        vocabulary = _vocabulary(path, source)
        return lambda texts: vocabulary.encode([x or "" for x in texts])

    return _mapped(docs, text, to, "binary", work)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in ``to``; null ids give an empty text."""
    to = spare(encoded, to)
    source = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def work():
        vocabulary = _vocabulary(path, source)
        return lambda rows: [vocabulary.decode(x or b"") for x in rows]

    return _mapped(encoded, ids, to, "string", work)


def token_count(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
