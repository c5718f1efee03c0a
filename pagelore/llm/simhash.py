"""SimHash near-duplicates by anchor points of a covering code.

Pairs at 4 or fewer differing bits differ in at most one bit of one of three parts of
the fingerprint. In a part of 21 or 22 bits the anchors are the words whose first 15
bits belong to the perfect Hamming(15, 11) code; the others are free. Every value has
one anchor within the covering radius of 1, its home. It also visits every anchor that
can be the home of a value one bit away, so at distance 2 at most (radius plus
threshold). Both ends of a link therefore meet at the home of either, and are
compared there with all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.components import components
from pagelore.llm.tables import saved, spare
from pagelore.llm.words import text_bytes

SHINGLE = 4
MAX_BITS = 4
#: (first bit, bits) of each part; MAX_BITS differing bits leave one part with at most one.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: An anchor with more homes than this, or than this share of all, is compared in cells.
CELL_HOMES, HOT_ANCHORS = 4096, 1 << 14
_PAIRS = 1 << 21


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:n - 1]]
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = zip(starts[at:at + (1 << 16)], ends[min(size, len(words)) - 1:][at:at + (1 << 16)])
        hashes = np.array([digest(line[s:e - 1], 42) for s, e in part], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """``docs`` without the text column but with its SimHash as a signed long.

    Words are split at ASCII white space and lower-cased in A-Z. Null and empty texts have
    fingerprint 0; every other column, whatever its name, is carried along.
    """
    kept = [c for c in docs.columns if c != text]
    hidden = spare(docs.select(*kept), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            view = memoryview(data)
            found = [fingerprint(bytes(view[a:b]), size) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.int64())], names=[*kept, hidden])

    schema = docs.select(*kept, F.lit(0).cast("long").alias(hidden)).schema
    return docs.select(*kept, text).mapInArrow(run, schema).withColumnRenamed(hidden, to)


def _syndrome(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code), np.uint64)
    for i in range(CODE_BITS):
        out ^= ((code >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def _flip(code: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``code`` with bit ``which - 1`` turned over; 0 leaves it."""
    return code ^ np.where(which > 0, np.uint64(1) << (np.maximum(which, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, is home) of every anchor each fingerprint is copied to."""
    rows, places, homes = [], [], []
    at = np.arange(len(prints))

    def add(which, place, home):
        rows.append(which)
        places.append(place)
        homes.append(np.full(len(which), home))

    for part, (first, bits) in enumerate(PARTS):
        value = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        code, free = value & np.uint64((1 << CODE_BITS) - 1), value >> np.uint64(CODE_BITS)
        off = _syndrome(code)
        nearest = _flip(code, off)
        tag = np.uint64(part << 32)
        home = tag | nearest | (free << np.uint64(CODE_BITS))
        add(at, home, True)
        add(at, home, False)
        for bit in range(bits - CODE_BITS):
            add(at, home ^ np.uint64(1 << (CODE_BITS + bit)), False)
        for j in range(1, CODE_BITS + 1):  # the code words two bits away: pairs j < j ^ off
            other = off ^ np.uint64(j)
            found = np.flatnonzero((off > 0) & (other > j))
            word = _flip(_flip(code[found], np.full(len(found), j)), other[found])
            add(found, tag | word | (free[found] << np.uint64(CODE_BITS)), False)
    return np.concatenate(rows), np.concatenate(places).astype(np.int64), np.concatenate(homes)


def _anchored(distinct: DataFrame, homes_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                prints = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                rows, places, homes = anchors(prints)
                if homes_only:
                    rows, places, homes = rows[homes], places[homes], homes[homes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array(prints[rows].view(np.int64)), pa.array(homes)],
                    names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of each a[i], b[i]; labels are the smallest index of a class."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _linked(key: np.ndarray, prints: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and visitors of the same key."""
    nodes, index = np.unique(prints, return_inverse=True)
    label = np.arange(len(nodes))
    h, v = np.flatnonzero(home), np.flatnonzero(~home)
    h, v = h[np.argsort(key[h], kind="stable")], v[np.argsort(key[v], kind="stable")]
    low = np.searchsorted(key[h], key[v], "left")
    n = np.searchsorted(key[h], key[v], "right") - low
    work = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(v):
        end = max(at + 1, int(np.searchsorted(work, work[at] + _PAIRS, "right")) - 1)
        count = n[at:end]
        mine = np.repeat(np.arange(at, end), count)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + low[mine]
        a, b = index[h[other]], index[v[mine]]
        near = (np.bitwise_count(nodes[a] ^ nodes[b]) <= bits) & (a < b)
        label = merge_labels(label, a[near], b[near])
        at = end
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v) links of distinct fingerprints ``fp`` that keep every class connected.

    Links within a task are thinned to a spanning forest; the classes are those of all
    links. An anchor with many homes is cut into cells of some homes and some visitors.
    """
    if bits > MAX_BITS:
        raise ValueError(f"the parts of the fingerprint cover {MAX_BITS} differing bits")
    homes = _anchored(distinct, True).groupBy("anchor").count()
    limit = max(CELL_HOMES, distinct.count() * len(PARTS) // HOT_ANCHORS)
    # at most HOT_ANCHORS rows, as together they hold all homes at most
    hot = homes.where(F.col("count") > limit).select("anchor", F.ceil(F.col("count") / limit).cast("int").alias("cells"))
    rows = _anchored(distinct, False).join(F.broadcast(hot), "anchor", "left").withColumn(
        "cells", F.coalesce("cells", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("cells") - 1)
    rows = rows.select("anchor", "fp", "home", F.explode(F.transform(all_, lambda other: F.when(
        F.col("home"), mine * F.col("cells") + other).otherwise(other * F.col("cells") + mine))).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False),
                  b.column(3).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        anchor, fp, home, cell = (np.concatenate(x) for x in zip(*parts))
        key = anchor * (1 << 24) + cell
        u, v = _linked(key, fp.view(np.uint64), home, bits)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return rows.repartition("anchor", "cell").mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS,
                   size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every row: its fingerprint and near-duplicate class.

    Rows link when their fingerprints differ in at most ``bits`` bits; the class carries
    the smallest ``doc_id`` reachable. A null id takes part but never names a class (null
    if a class has no other); repeated rows give repeated rows; an empty table gives none.
    ``text_key`` is the text's xxhash64, to tell rows of one id apart.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    prints = saved(fingerprints(rows, to="fp", size=size), "simhash")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = components(links(nodes, bits))
    named = saved(nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "classes")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of its smallest id.

    Of several rows with that id in the class, the one with the lowest text hash stays, and
    one only of equal texts. Rows with a null id stay, as nothing tells them apart.
    """
    key, place = spare(docs, "text_key"), spare(docs, "copy_no")
    groups = simhash_groups(docs, doc_id, text, bits)
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("text_key")).select(
        F.col("doc_id").alias(doc_id), F.col("text_key").alias(key))
    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))
    copies = Window.partitionBy(doc_id, key).orderBy(key)
    one = keyed.join(kept, [doc_id, key], "left_semi").withColumn(place, F.row_number().over(copies)).where(
        F.col(place) == 1)
    return one.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
