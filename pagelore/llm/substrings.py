"""Exact substring dedup: repeated token windows found by Rabin-Karp hashes counted in Spark.

Every window of ``width`` words gets a rolling hash. Windows are dealt by the smallest
hash among their runs of KEY_WORDS words: equal windows have the same one, and
neighbouring windows mostly share it, so a row carries some twenty window hashes and the
shuffle moves them once, in 7 bytes each. A batch sends an equal window for its smallest
document only, however often a hot passage comes. The windows of every deal are counted
first: a passage shorter than a window, in front of ever other words, makes one deal of all
its windows, and a deal of more than HOT_WINDOWS is split by the windows' own hashes. Tasks
read their deals in order and hold one at a time. Windows that also start in a smaller
document are marked, runs of marked windows are merged into maximal intervals, and the
intervals meet the texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.tables import spare
from pagelore.llm.words import SPACED, mix, rolling, sliding_min, starts_of, text_bytes, word_groups

WIDTH = 50
KEY_WORDS = 16
HASH_BYTES = 7            # other words agree in a part of HOT_WINDOWS windows with a chance of 2^-17
HOT_WINDOWS = 1 << 20     # windows of one deal that one task compares
MOST_HOT = 1 << 20        # deals split at most, the largest first: 16 MB of names and sizes
HELD_BYTES = 1 << 25      # rows a task gathers before it compares the deals that are complete
_MASK = np.uint64((1 << 8 * HASH_BYTES) - 1)
_ROW = "deal long, doc_id long, text_key long, first int, n int, hashes binary"


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpack(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


def _repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, whether a smaller document has it."""
    order = np.lexsort((doc, key))
    ordered = key[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    low = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    later = np.empty(len(key), bool)
    later[order] = doc[order] > low
    return later


def _runs(change: np.ndarray) -> np.ndarray:
    """Bounds of the runs that begin where ``change`` is true."""
    return np.append(np.flatnonzero(change), len(change))


def _rows(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["deal", "doc_id", "text_key", "first", "n", "hashes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _split(key: np.ndarray, window: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The deals ``key``, those that are hot in as many parts as they need: equal windows stay together."""
    deals, parts = hot
    if not len(deals):
        return key
    at = np.minimum(np.searchsorted(deals, key), len(deals) - 1)
    part = mix(window) % np.where(deals[at] == key, parts[at], np.uint64(1))
    return np.where(deals[at] == key, mix(key + part), key)


def _hashed(batch: pa.RecordBatch, width: int, hot: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Rows of windows to compare (with hashes) and of windows already known as later copies
    (without). Without ``hot``, only (deal, n): how many windows of a deal there are to compare."""
    short = min(KEY_WORDS, width)
    windows, keys, places, rows = [], [], [], []
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    texts = batch.column(1).to_numpy(zero_copy_only=False)
    once = np.zeros(len(ids), bool)   # rows that repeat id and text share their verdict
    once[np.unique(np.stack([ids, texts]), axis=1, return_index=True)[1]] = True
    for row, counts, hashes in word_groups(batch.column(2), SPACED):
        whole, part = rolling(hashes, width), sliding_min(rolling(hashes, short, 1), width - short + 1)
        begins = starts_of(counts)
        n = np.where(once[row:row + len(counts)], np.maximum(counts - width + 1, 0), 0)
        at = np.repeat(begins[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows.append(whole[at])
        keys.append(part[at])
        rows.append(np.repeat(np.arange(row, row + len(counts)), n))
        places.append(at - np.repeat(begins[:-1], n))
    if not windows:
        return
    window, key, row, place = map(np.concatenate, (windows, keys, rows, places))
    if not len(window):
        return
    docs = ids[row]
    later = _repeated(window, docs)
    if hot is None:
        deals, n = np.unique(key[~later], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(deals.view(np.int64)), pa.array(n, pa.int64())], names=["deal", "n"])
        return
    begins = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))
    marked = np.append(True, later[1:] != later[:-1])
    bounds = _runs(begins | marked)
    mine = bounds[:-1][later[bounds[:-1]]]
    sizes = np.diff(bounds)[later[bounds[:-1]]]
    if len(mine):
        yield _rows([mix(docs[mine].astype(np.uint64)).view(np.int64), docs[mine], texts[row[mine]], place[mine], sizes,
                     [b""] * len(mine)])
    sent = np.flatnonzero(~later)
    key, row, place, window = _split(key[sent], window[sent], hot), row[sent], place[sent], window[sent]
    bounds = _runs(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)))
    packed = _pack(window)
    for i in range(0, len(bounds) - 1, 1 << 16):
        cut = bounds[i:i + (1 << 16) + 1]
        a = cut[:-1]
        yield _rows([key[a].view(np.int64), docs[sent[a]], texts[row[a]], place[a], np.diff(cut),
                     [packed[HASH_BYTES * x:HASH_BYTES * y] for x, y in zip(a.tolist(), cut[1:].tolist())]])


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, ordered by deal, in tables that never cut a deal."""
    held, size, limit = [], 0, HELD_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        whole = pa.Table.from_batches(held)
        deals = whole.column(0).to_numpy()
        cut = int(np.searchsorted(deals, deals[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held)
        limit = HELD_BYTES + 2 * size   # a long deal is not gathered anew for every batch
    if held:
        yield pa.Table.from_batches(held)


def _compared(whole: pa.Table) -> pa.RecordBatch:
    """(doc_id, text_key, first, n) of runs of windows that a smaller document has too."""
    deal, doc, text, first, n = (whole.column(i).to_numpy() for i in range(5))
    data = whole.column(5).combine_chunks().cast(pa.large_binary())
    _, offsets, raw = data.buffers()
    bounds = np.frombuffer(offsets, np.int64)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    count = np.diff(bounds) // HASH_BYTES
    row = np.repeat(np.arange(len(deal)), count)
    place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    rows = np.flatnonzero(count == 0)   # known from their batch
    firsts, lengths = first[rows], n[rows]
    if len(row):
        key = mix(_unpack(raw) ^ (deal.view(np.uint64)[row] << np.uint64(1)))
        later = _repeated(key, doc[row])
        hit = np.flatnonzero(later)
        if len(hit):
            bounds = _runs(np.append(True, (row[hit][1:] != row[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)))
            a = hit[bounds[:-1]]
            rows = np.concatenate([rows, row[a]])
            firsts, lengths = np.concatenate([firsts, place[a]]), np.concatenate([lengths, np.diff(bounds)])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[rows]), pa.array(text[rows]), pa.array(firsts, pa.int32()), pa.array(lengths, pa.int32())],
        names=["doc_id", "text_key", "first", "n"])


def hot_deals(rows: DataFrame, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals of more than ``limit`` windows, in order, and how many parts each is split into."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _hashed(batch, width, None)

    heavy = rows.mapInArrow(weigh, "deal long, n long").groupBy("deal").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    found = heavy.orderBy(F.desc("n"), "deal").limit(MOST_HOT).toArrow()
    deals, n = found.column("deal").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(deals)
    return deals[order], (-(-n // limit)).astype(np.uint64)[order]


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                     hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """(doc_id, text_key, first, n): runs of n windows, by their first word, that a document
    with a smaller id has too. Rows without an id or with fewer words have none. Deals of more
    than ``hot_windows`` windows are split; beyond MOST_HOT such deals the smaller ones stay whole."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text))
    hot = docs.sparkSession.sparkContext.broadcast(hot_deals(rows, width, hot_windows))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _hashed(batch, width, hot.value)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _complete(batches):
            yield _compared(whole)

    dealt = rows.mapInArrow(split, _ROW).repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(compare, "doc_id long, text_key long, first int, n int")


def _merged(first: np.ndarray, n: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Word intervals covered by windows, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, size in sorted(zip(first.tolist(), n.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + size + width - 1)
        else:
            out.append([a, a + size + width - 1])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """``docs`` plus kept_text, n_words, n_removed and the removed word intervals ``spans``.

    Words are those between ASCII white space (null: none). A word goes when a window of
    ``width`` words over it also starts in a document with a smaller id; the first copy
    always stays whole. Kept words are joined by one space. Rows that share an id do not
    count against each other; a null id is never smaller or larger than another. A column
    that ``docs`` has already keeps its name, and the new one gets underscores at its end.
    """
    names, added = docs.columns, [spare(docs, c) for c in ("kept_text", "n_words", "n_removed", "spans")]
    windows = repeated_windows(docs, doc_id, text, width, hot_windows)
    marks = windows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    id_, key, runs = (spare(docs, c) for c in ("doc_id_", "text_key", "runs"))
    marks = marks.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key),
                         F.col("runs.first").alias(runs), F.col("runs.n").alias(runs + "n"))
    left = docs.withColumns({id_: F.col(doc_id).cast("long"), key: F.xxhash64(F.col(text))})
    met = left.join(marks, [id_, key], "left").select(*names, runs, runs + "n")
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                batch = whole.slice(row, 512)
                data, offsets = text_bytes(batch.column(at))
                view = memoryview(data)
                first, n = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
                kept, total, gone, spans = [], [], [], []
                for i in range(batch.num_rows):
                    words = bytes(view[offsets[i]:offsets[i + 1]]).split()
                    found = _merged(first[i].values.to_numpy(), n[i].values.to_numpy(), width) if first[i].is_valid else []
                    total.append(len(words))
                    gone.append(sum(b - a for a, b in found))
                    spans.append([{"start": a, "stop": b} for a, b in found])
                    for a, b in reversed(found):
                        del words[a:b]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
                     pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    names=[*names, *added])

    schema = docs.select("*", F.lit("").alias(added[0]), F.lit(0).cast("long").alias(added[1]),
                         F.lit(0).cast("long").alias(added[2]),
                         F.lit(None).cast("array<struct<start:long,stop:long>>").alias(added[3])).schema
    return met.mapInArrow(cut, schema)
