"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors of one label are dealt into tiles. A pair of tiles is one task: unit vectors are
rounded to 8-bit multiples of a scale of their own, and the products of the rounded
vectors are exact integers. With the error e of each vector's rounding, a product is off
by at most ``e_x + (1 + e_x) e_y``. Pairs beyond the threshold by more than that are
links, pairs below it by more are none, and the few between are computed in double
precision from the full vectors.

Equal vectors of a label are one class with a multiplicity. Links are counted where they
are found and thinned to a spanning forest there, so a group of thousands of near copies
gives thousands of rows, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.components import components
from pagelore.llm.simhash import merge_labels
from pagelore.llm.tables import saved

COSINE = 0.93
TILE, STRIP = 4096, 512
#: Added to every bound for the rounding of float arithmetic itself.
SLACK = 1e-5


class _Tile:
    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, times: np.ndarray):
        self.nodes, self.times = nodes, times.astype(np.float64)
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        whole = np.rint(self.unit / self.scale[:, None])
        self.error = np.linalg.norm(self.unit - whole * self.scale[:, None], axis=1)
        self.whole = whole.astype(np.int8)


def compare(x: _Tile, y: _Tile, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each x, links of each y, and the forest as indices into x then y)."""
    size, base = len(x.nodes), 0 if same else len(x.nodes)
    label = np.arange(base + len(y.nodes))
    left, right = np.zeros(size), np.zeros(len(y.nodes))
    other = y.whole.astype(np.float32).T
    for at in range(0, size, STRIP):
        part = slice(at, at + STRIP)
        near = (x.whole[part].astype(np.float32) @ other).astype(np.float64)   # integers, exact up to 2**24
        near *= x.scale[part, None]
        near *= y.scale
        bound = x.error[part, None] + (1 + x.error[part, None]) * y.error + SLACK
        linked = near - bound >= cosine
        i, j = np.nonzero((near + bound >= cosine) & ~linked)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            linked[a, b] = np.einsum("ij,ij->i", x.unit[at + a], y.unit[b]) >= cosine
        if same:
            own = np.arange(len(linked))
            linked[own, at + own] = False
        left[part] += linked @ y.times
        right += x.times[part] @ linked
        i, j = np.nonzero(linked)
        label = merge_labels(label, at + i, base + j)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return left, right, moved, label[moved]


def _compared(table: pa.Table, same: bool, cosine: float) -> pa.RecordBatch:
    def tile(side: pa.Table) -> _Tile:
        values = side.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return _Tile(side.column("node").to_numpy(), values.reshape(side.num_rows, -1), side.column("times").to_numpy())

    first = table.column("first").to_numpy(zero_copy_only=False)
    x = tile(table.filter(pa.array(first)))
    y = x if same else tile(table.filter(pa.array(~first)))
    left, right, moved, root = compare(x, y, same, cosine)
    nodes = x.nodes if same else np.concatenate([x.nodes, y.nodes])
    counts = left if same else np.concatenate([left, right])
    some = np.flatnonzero(counts)
    u, v = np.concatenate([nodes[some], nodes[moved]]), np.concatenate([nodes[some], nodes[root]])
    return pa.RecordBatch.from_arrays(
        [pa.array(u), pa.array(v), pa.array(np.concatenate([counts[some], np.zeros(len(moved))]).astype(np.int64))],
        names=["u", "v", "n"])


def _usable(vector: str):
    """Not null or empty, without null, infinite or NaN parts, and not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when label and length of their vectors are equal and their cosine is at least
    ``cosine`` (above 0). Unusable vectors (see :func:`_usable`) and null labels link with
    nothing. ``component_id`` is the smallest id reachable; rows with a null id link, but
    name a component only by null; equal rows are rows of their own and link.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    usable = F.col("label").isNotNull() & _usable("vector")
    # adding zero makes -0.0 and 0.0 the same number
    plain = F.transform("vector", lambda x: x + F.lit(0).cast(_part_type(rows, vector)))
    keyed = named.withColumn("vector", F.when(usable, plain)).withColumn(
        "node", F.when(usable, F.xxhash64("label", "vector")))
    whole = saved(keyed.where("node is not null"), "vectors")
    classes = saved(whole.groupBy("node", "label").agg(
        F.first("vector").alias("vector"), F.count("*").alias("times"), F.min("vec_id").alias("low")).withColumn(
        "size", F.size("vector")), "classes")
    counts = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.join(counts, ["label", "size"]).withColumn("t", F.pmod(F.xxhash64("node", F.lit(1)), "tiles").cast("int"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    pairs = dealt.select(
        "label", "size", "node", "vector", "times", "t", F.explode(other).alias("o")).select(
        "label", "size", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") <= F.col("o")).alias("first"),
        "node", "vector", "times")
    key = ["label", "size", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        name = None

        def settle():
            if waiting:
                found = _compared(pa.Table.from_batches(waiting), name[2] == name[3], cosine)
                waiting.clear()
                yield found

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if keys[low] != name:
                    yield from settle()
                    name = keys[low]
                waiting.append(batch.slice(low, high - low))
        yield from settle()

    found = saved(pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long, n long"), "links")
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(found.where("u <> v").select("u", "v"))
    marked = classes.join(links, classes["node"] == links["u"], "left").join(
        roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "node", "low", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    marked = saved(marked, "marked")
    lowest = marked.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = marked.join(lowest, "root").select("node", "n_links", "component_id")
    linked = whole.select("vec_id", "node").join(by_class, "node").select("vec_id", "n_links", "component_id")
    alone = keyed.where("node is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _part_type(rows: DataFrame, vector: str):
    return rows.schema[vector].dataType.elementType
