"""Words of whole texts as 64-bit hashes, many texts per numpy call.

A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums, so
hashing costs a few array passes per byte and no Python step per word. A text of any
length is read in pieces that end between words; no text is cut or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C13
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words(NamedTuple):
    """Which bytes belong to words, and the code each byte counts as."""

    inside: np.ndarray
    codes: np.ndarray


def _words(inside: np.ndarray, lower: bool) -> Words:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return Words(inside, codes)


_ALL = np.arange(256)
_SPACE = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
_PLAIN = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | ((_ALL >= 65) & (_ALL <= 90)) | (_ALL >= 128)
#: Words between white space, unchanged; the same in lower case; letters and digits in lower case.
SPACED, SPACED_LOWER, PLAIN_LOWER = _words(~_SPACE, False), _words(~_SPACE, True), _words(_PLAIN, True)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_spans(data: np.ndarray, inside: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; ``firsts`` are the places where a text begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[firsts] = True
    edge[0] = edge[-1] = True
    starts = within.copy()
    starts[1:] &= ~within[:-1] | edge[1:-1]
    ends = within
    ends[:-1] &= ~within[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _long_text(data: np.ndarray, rule: Words) -> np.ndarray:
    """Word hashes of one text, in pieces that end outside words."""
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data):
            outside = np.flatnonzero(~rule.inside[data[at:end]])
            if len(outside):
                end = at + int(outside[-1]) + 1
                break
            end = min(end + PIECE_BYTES, len(data))
        piece = data[at:end]
        found.append(span_hashes(piece, rule.codes, *word_spans(piece, rule.inside, np.zeros(1, np.int64))))
        at = end
    return np.concatenate(found)


def word_groups(column, rule: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, hashes of all their words) for groups of texts."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[stop])
        if high - low > PIECE_BYTES:
            hashes = _long_text(data[low:high], rule)
            counts = np.array([len(hashes)])
        else:
            chunk, at = data[low:high], offsets[row:stop + 1] - low
            starts, ends = word_spans(chunk, rule.inside, at)
            hashes = span_hashes(chunk, rule.codes, starts, ends)
            counts = np.diff(np.searchsorted(starts, at))
        yield row, counts, hashes
        row = stop


def rolling(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, modulo 2**64 and mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((mix(values + np.uint64(salt)) if salt else values) * power[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:]) if span < width else values


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group of ``counts`` begins, and where the last one ends."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out
