"""Benchmark decontamination by winnowing.

A window of ``width`` words holds ``width - gram + 1`` grams of ``gram`` words; the
smallest hash among them is the window's fingerprint. Equal windows have equal
fingerprints wherever they stand, so every shared span of ``width`` words is found. The
fingerprints of the items are joined with those of each text, and each hit is extended:
the whole window is compared by a 128-bit hash. Items shorter than a window are one
window of their own length.

Item windows are sent to the workers in blocks of at most BLOCK_WINDOWS, one pass over
the documents each, so a benchmark of any size needs no shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.tables import dropped, saved, spare
from pagelore.llm.words import PLAIN_LOWER, rolling, sliding_min, starts_of, word_groups

WIDTH, GRAM = 10, 5
BLOCK_WINDOWS = 1_000_000
_SECOND = 0x5DEECE66D


def _fingerprints(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The winnowed gram of every window of ``width`` words."""
    gram = min(gram, width)
    return sliding_min(rolling(hashes, gram, 1), width - gram + 1)


def _window_hashes(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(hashes, width, 2), rolling(hashes, width, _SECOND)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH,
                 gram: int = GRAM) -> DataFrame:
    """(size, fp, h1, h2, item): every window of every item, once. Items without words or id have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts, hashes in word_groups(batch.column(1), PLAIN_LOWER):
                bounds = starts_of(counts)
                for i in range(len(counts)):
                    mine = hashes[bounds[i]:bounds[i + 1]]
                    if not len(mine):
                        continue
                    size = min(width, len(mine))
                    columns = np.unique(np.stack([_fingerprints(mine, size, gram), *_window_hashes(mine, size)]), axis=1)
                    n = columns.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, size, np.int32)), *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(columns)),
                         pa.array([batch.column(0)[row + i].as_py()] * n, pa.string())],
                        names=["size", "fp", "h1", "h2", "item"])

    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text))
    return items.mapInArrow(run, "size int, fp long, h1 long, h2 long, item string").distinct()


class _Block:
    """Windows of one size: their fingerprints, their hashes and the items that have them."""

    def __init__(self, fp: np.ndarray, h1: np.ndarray, h2: np.ndarray, items: np.ndarray):
        self.fp = np.unique(fp)
        self.bits = np.uint64(64 - max(16, int(len(self.fp)).bit_length() + 6))
        self.maybe = np.zeros(1 << int(64 - int(self.bits)), bool)
        self.maybe[(self.fp >> self.bits).astype(np.int64)] = True
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.items = h1[order], h2[order], items[order]
        change = np.append(True, (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1]))
        self.bounds = np.append(np.flatnonzero(change), len(order))
        self.h1, self.h2 = self.h1[self.bounds[:-1]], self.h2[self.bounds[:-1]]

    def candidates(self, fingerprints: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(fingerprints >> self.bits).astype(np.int64)])
        found = np.searchsorted(self.fp, fingerprints[at])
        return at[self.fp[np.minimum(found, len(self.fp) - 1)] == fingerprints[at]]

    def match(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The class of each window hash, or -1; equal h1 with another h2 are looked at in turn."""
        at = np.searchsorted(self.h1, h1)
        out = np.full(len(h1), -1)
        while True:
            inside = np.minimum(at, len(self.h1) - 1)
            same = (at < len(self.h1)) & (self.h1[inside] == h1)
            out[same & (self.h2[inside] == h2)] = inside[same & (self.h2[inside] == h2)]
            if not (same & (out < 0)).any():
                return out
            at = at + 1


def _found(hashes: np.ndarray, counts: np.ndarray, blocks: dict[int, _Block], gram: int):
    """(row, first word, size, class) of every item window in a group of texts."""
    begins = starts_of(counts)
    for size, block in blocks.items():
        if len(hashes) < size:
            continue
        at = block.candidates(_fingerprints(hashes, size, gram))
        row = np.searchsorted(begins, at, "right") - 1
        whole = at + size <= begins[row + 1]
        at, row = at[whole], row[whole]
        if not len(at):
            continue
        near = at[:, None] + np.arange(size)
        words = hashes[near].ravel()
        starts = np.arange(len(at)) * size
        h1, h2 = (x[starts] for x in _window_hashes(words, size))
        which = block.match(h1, h2)
        hit = which >= 0
        yield row[hit], at[hit] - begins[row[hit]], size, which[hit], block


def _union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(b, out[-1]["stop"])
        else:
            out.append({"start": a, "stop": b})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, gram: int = GRAM,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` plus n_words, hit_spans (word intervals inside item windows) and item_ids.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Null
    texts have no words; items without an id or without words match nothing; an id that
    comes more than once counts once; an empty benchmark hits nothing. A column that
    ``docs`` has already keeps its name, and the new one gets underscores at its end.
    """
    names, added = docs.columns, [spare(docs, c) for c in ("n_words", "hit_spans", "item_ids")]
    spark = docs.sparkSession
    windows = saved(item_windows(benchmark, item_id, item_text, width, gram), "windows")
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    at = names.index(text)
    out = docs.select("*", F.lit(0).cast("long").alias(added[0]),
                      F.array().cast("array<struct<start:long,stop:long>>").alias(added[1]),
                      F.array().cast("array<string>").alias(added[2]))
    schema = out.schema
    past = None
    for number in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("h1", "item"), F.lit(blocks)) == number).toArrow()
        sent = spark.sparkContext.broadcast(
            [part.column(c).to_numpy() for c in ("size", "fp", "h1", "h2")] + [part.column("item").to_pylist()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, fp, h1, h2, items = sent.value
            items = np.array(items, object)
            made = {}
            for n in np.unique(size).tolist():
                of = size == n
                made[n] = _Block(*(x[of].view(np.uint64) for x in (fp, h1, h2)), items[of])
            for whole in batches:
                for low in range(0, whole.num_rows, 1024):
                    batch = whole.slice(low, 1024)
                    total = np.zeros(batch.num_rows, np.int64)
                    spans, ids = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                    for first, counts, hashes in word_groups(batch.column(at), PLAIN_LOWER):
                        total[first:first + len(counts)] = counts
                        hits: dict[int, list[tuple[int, int]]] = {}
                        seen: dict[int, set[str]] = {}
                        for rows, places, n, classes, block in _found(hashes, counts, made, gram):
                            for row, place in zip(rows.tolist(), places.tolist()):
                                hits.setdefault(row, []).append((place, place + n))
                            for row, which in set(zip(rows.tolist(), classes.tolist())):
                                seen.setdefault(row, set()).update(block.items[block.bounds[which]:block.bounds[which + 1]])
                        for row, found in hits.items():
                            i = first + row
                            spans[i] = _union([*((s["start"], s["stop"]) for s in spans[i]), *found])
                            ids[i] = sorted({*ids[i], *seen[row]})
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:-3], pa.array(total), pa.array(spans, span), pa.array(ids, pa.list_(pa.string()))],
                        names=[*names, *added])

        out = out.mapInArrow(run, schema)
        if number < blocks - 1:   # one block's windows in a worker at a time
            out = saved(out, "contamination")
            if past is not None:
                dropped(past)
            past = out
    return out


def hit_words(spans: str = "hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of an item; every other row unchanged."""
    inner = [f"c{i}" for i in range(len(docs.columns))]   # the columns' own names may clash with the results'
    found = contamination(docs.toDF(*inner), benchmark, inner[docs.columns.index(text)])
    return found.where(F.size("hit_spans") == 0).select(*inner).toDF(*docs.columns)
