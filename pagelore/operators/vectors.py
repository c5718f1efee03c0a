"""Embedding fill, pooling and exact vector top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.functions import text, vectors
from pagelore.operators.keywords import SCORE_DIGITS, top_k
from pagelore.session import materialize

Encoder = Callable[[Sequence[str]], np.ndarray]

QUERY_BLOCK = 4_096      # query vectors held by one task
CORPUS_BLOCK = 50_000    # chunks per cell when the query set is too large to broadcast
SCORES_AT_ONCE = 4_000_000
HITS = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def encode_batches(rows: DataFrame, encoder: Callable[[], Encoder], title: str = "page_title",
                   heading: str = "heading_path", content: str = "content",
                   batch: int = 64) -> DataFrame:
    """Encode every row in batches of ``batch``; ``encoder()`` is loaded once per task."""
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "embedding"]
        + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    own = [f.name for f in schema.fields[:-1]]
    ready = rows.select(
        *own, text.embed_input(F.col(title), F.col(heading), F.col(content)).alias("__input"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                out = part[own].copy()
                out["embedding"] = list(np.asarray(encode(part["__input"].tolist()), dtype="float32"))
                yield out

    return ready.mapInPandas(run, schema)


def embed_missing(chunks: DataFrame, encoder: Callable[[], Encoder], **names: str) -> DataFrame:
    """Fill NULL embeddings only; filled rows pass by untouched."""
    # Missing rows sit together after a rebuild; encoding is dear, so spread them.
    missing = chunks.where(F.col("embedding").isNull()).repartition("chunk_id")
    filled = chunks.where(F.col("embedding").isNotNull())
    return filled.unionByName(encode_batches(missing, encoder, **names))


def hashed_term_encoder(dims: int = 64) -> Callable[[], Encoder]:
    """Stand-in encoder: terms hashed into ``dims`` counters, scaled to length 1."""

    def load() -> Encoder:
        import hashlib
        import re

        words = re.compile(r"[^\W_]+")

        @lru_cache(maxsize=200_000)
        def slot(term: str) -> int:
            return int(hashlib.md5(term.encode()).hexdigest()[:7], 16) % dims

        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for i, one in enumerate(texts):
                for term in words.findall(one.lower()):
                    out[i, slot(term)] += 1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return load


def mean_pool_normalize(tokens: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """Weighted mean of the vectors of each key, scaled to length 1.

    Sums run per (key, position), so map-side aggregation absorbs a hot key."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    summed = tokens.select(key, w.alias("w"), F.posexplode(vector).alias("pos", "x")).groupBy(
        key, "pos").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    pooled = summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    mean = pooled.select(key, F.transform("p", lambda r: r["x"]).alias("mean"))
    return mean.select(key, vectors.unit(F.col("mean")).alias("embedding"))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the best ``k`` columns per row; equal scores go to the first columns.

    Copies of one vector may fill the block with ties, so ties are counted, not
    collected."""
    n = scores.shape[1]
    if n <= k:
        return np.ones_like(scores, dtype=bool)
    bar = np.partition(scores, n - k, axis=1)[:, n - k, None]
    mask = scores >= bar
    tied = np.nonzero(mask.sum(axis=1) > k)[0]
    if len(tied):
        above, equal = scores[tied] > bar[tied], scores[tied] == bar[tied]
        room = k - above.sum(axis=1, keepdims=True)
        mask[tied] = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room))
    return mask


class _TopK:
    """Running best ``k`` chunks per query: higher score first, then lower id."""

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, exclude_same: bool):
        self.qids, self.k, self.exclude_same = qids, k, exclude_same
        self.queries = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.row = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0)

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        step = max(1, SCORES_AT_ONCE // max(1, len(self.qids)))
        for at in range(0, len(ids), step):
            self._add(ids[at:at + step], matrix[at:at + step])

    def _add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        length = np.linalg.norm(matrix, axis=1)
        by_id = np.argsort(ids, kind="stable")
        by_id = by_id[length[by_id] > 0]
        ids, matrix, length = ids[by_id], matrix[by_id], length[by_id]
        if not len(ids):
            return
        scores = np.round(self.queries @ (matrix / length[:, None]).T, SCORE_DIGITS)
        if self.exclude_same:
            scores[self.qids[:, None] == ids[None, :]] = -np.inf
        row, col = np.nonzero(_best(scores, self.k))
        real = np.isfinite(scores[row, col])
        row, col = row[real], col[real]
        row = np.concatenate([self.row, row])
        all_ids = np.concatenate([self.ids, ids[col]])
        all_scores = np.concatenate([self.scores, scores[row[len(self.row):], col]])
        order = np.lexsort((all_ids, -all_scores, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = order[place < self.k]
        self.row, self.ids, self.scores = row[place < self.k], all_ids[best], all_scores[best]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.qids[self.row], pa.int64()), pa.array(self.ids, pa.int64()),
             pa.array(self.scores, pa.float64())],
            names=["qid", "chunk_id", "score"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def vector_scores(queries: DataFrame, corpus: DataFrame, k: int, exclude_same: bool = False) -> DataFrame:
    """Local best ``k`` per query and task, as ``qid, chunk_id, score``.

    ``queries``: ``qid, qvec``; ``corpus``: ``chunk_id, embedding``. NULL vectors
    are left out. A query set within one block is broadcast and the corpus is
    read once without a shuffle; a larger one meets the corpus in cells of a
    bounded number of queries and chunks. Either way only k rows per query leave
    a task, and no query-chunk pair is ever a row.
    """
    corpus = corpus.select(F.col("chunk_id").cast("long"), "embedding").where(F.col("embedding").isNotNull())
    queries = queries.select(F.col("qid").cast("long"), "qvec").where(F.col("qvec").isNotNull())
    head = queries.limit(QUERY_BLOCK + 1).toArrow()
    if not head.num_rows:
        return queries.sparkSession.createDataFrame([], HITS)
    if head.num_rows > QUERY_BLOCK:
        return _cell_scores(queries, corpus, k, exclude_same)
    return _broadcast_scores(head, corpus, k, exclude_same)


def _broadcast_scores(head: pa.Table, corpus: DataFrame, k: int, exclude_same: bool) -> DataFrame:
    # At most QUERY_BLOCK vectors.
    block = corpus.sparkSession.sparkContext.broadcast(
        (head.column("qid").to_numpy(), _matrix(head.column("qvec"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _TopK(*block.value, k, exclude_same)
        for b in batches:
            best.add(b.column(0).to_numpy(), _matrix(b.column(1)))
        yield best.batch()

    return corpus.mapInArrow(run, HITS)


def _cell_scores(queries: DataFrame, corpus: DataFrame, k: int, exclude_same: bool) -> DataFrame:
    n_q = max(1, ceil(queries.count() / QUERY_BLOCK))
    n_c = max(1, ceil(corpus.count() / CORPUS_BLOCK))

    def blocks(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("q", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("c", blocks(n_c))
    right = corpus.withColumn("c", F.pmod(F.xxhash64("chunk_id"), F.lit(n_c)).cast("int")).withColumn("q", blocks(n_q))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.Table.from_batches([], pa.schema(
                [("qid", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]))
        best = _TopK(q.column("qid").to_numpy(), _matrix(q.column("qvec")), k, exclude_same)
        best.add(c.column("chunk_id").to_numpy(), _matrix(c.column("embedding")))
        return pa.Table.from_batches([best.batch()])

    return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(run, HITS)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_same: bool = False) -> DataFrame:
    """Exact nearest chunks by cosine: ``qid, chunk_id, score, rank`` (E5)."""
    return top_k(vector_scores(queries, corpus, k, exclude_same), k)


def _codes(matrix: np.ndarray, planes: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table, code): which sides of a table's planes a vector lies on, as bits. Further probes
    flip one bit each, those of the nearest planes first."""
    margins = np.einsum("nd,tbd->ntb", matrix, planes)
    tables, bits = planes.shape[:2]
    code = ((margins > 0) << np.arange(bits)).sum(axis=2)
    probes = min(probes, bits + 1)
    flips = np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, :probes - 1]
    codes = np.concatenate([code[:, :, None], code[:, :, None] ^ (1 << flips)], axis=2)
    rows, table = np.repeat(np.arange(len(matrix)), tables * probes), np.tile(np.repeat(np.arange(tables), probes), len(matrix))
    return rows, table, codes.ravel()


def _in_buckets(rows: DataFrame, planes: np.ndarray, probes: int) -> DataFrame:
    """``(id, vector)`` rows once per probed bucket, as ``t, code, id, vector``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_024):
                part = b.slice(at, 1_024)
                row, table, code = _codes(_matrix(part.column(1)), planes, probes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table, pa.int32()), pa.array(code, pa.int64()), part.column(0).take(pa.array(row)),
                     part.column(1).take(pa.array(row))], names=["t", "code", "id", "v"])

    return rows.mapInArrow(run, T.StructType([
        T.StructField("t", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("v", rows.schema.fields[1].dataType)]))


def vector_topk_lsh(queries: DataFrame, corpus: DataFrame, k: int, tables: int = 12, probes: int = 8,
                    bucket_rows: int = 256, seed: int = 7) -> DataFrame:
    """Approximate top-k (E6, off by default): a query is compared by exact cosine with the chunks of
    its bucket and of the nearest other buckets in each of ``tables`` hash tables.

    Buckets come from the signs of random projections, as many as give about ``bucket_rows`` chunks
    each. A bucket that holds more than ``CORPUS_BLOCK`` (copies) is cut into cells, which a query
    visits all. Queries that find fewer than ``k`` chunks are answered by the exact search."""
    corpus = corpus.select(F.col("chunk_id").cast("long"), "embedding").where(F.col("embedding").isNotNull())
    queries = queries.select(F.col("qid").cast("long"), "qvec").where(F.col("qvec").isNotNull())
    one, total = corpus.first(), corpus.count()
    if one is None:
        return vector_topk(queries, corpus, k)
    bits = int(np.clip(ceil(np.log2(max(2, total / bucket_rows))), 1, 40))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, len(one["embedding"])))
    right, left = _in_buckets(corpus, planes, 1), _in_buckets(queries, planes, probes)
    cells = right.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / CORPUS_BLOCK).alias("cells"))
    cut = materialize(cells.where("cells > 1"), "cells")
    right = right.join(cut, ["t", "code"], "left").withColumn("cell", F.pmod(F.xxhash64("id"), F.coalesce("cells", F.lit(1)))).drop("cells")
    left = left.join(cut, ["t", "code"], "left").withColumn(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cells", F.lit(1)) - 1))).drop("cells")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.Table.from_batches([], pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]))
        best = _TopK(q.column("id").to_numpy(), _matrix(q.column("v")), k, False)
        best.add(c.column("id").to_numpy(), _matrix(c.column("v")))
        return pa.Table.from_batches([best.batch()])

    key = ("t", "code", "cell")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, HITS)
    found = materialize(top_k(near.dropDuplicates(["qid", "chunk_id"]), k), "hits")
    full = found.where(F.col("rank") == k).select("qid")
    rest = materialize(queries.join(full, "qid", "left_anti"), "rest")
    if not rest.limit(1).count():
        return found
    return found.join(full, "qid", "left_semi").unionByName(vector_topk(rest, corpus, k))
