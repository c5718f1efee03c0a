"""Quality by nearest-neighbour voting in a latent semantic space.

A text's terms are its byte trigrams, hashed into 2**bits places, and its repetition in
steps: the share of words that repeat the one before, and of words seen before. Counts
are damped, weighted by rarity and normalised; a truncated singular value decomposition
of the labelled sample turns them into ``dims`` numbers. The labelled vectors go to the
workers, every document is compared with all of them by blocked cosine products, and its
nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.tables import bucket_of, spare
from pagelore.llm.words import PIECE_BYTES, SPACED, starts_of, text_bytes, word_groups

BITS = 12
STEPS, STEP_WEIGHT = 16, 0.3
#: At most this many labelled rows are learnt from: those whose ids hash lowest.
TRAINING_ROWS = 5_000
DIMS, NEIGHBOURS, POWER = 48, 15, 4
BLOCK_ROWS = 256
TERMS = (1 << BITS) + 2 * STEPS


class Model(NamedTuple):
    rarity: np.ndarray      # weight of each term
    axes: np.ndarray        # terms x dims
    vectors: np.ndarray     # labelled rows x dims, of length 1
    labels: np.ndarray


def _gram_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams of each text of a stretch of bytes."""
    texts = len(bounds) - 1
    x = data.astype(np.uint32)
    if len(x) < 3:
        return np.zeros((texts, 1 << BITS))
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    of = np.repeat(np.arange(texts), np.diff(bounds))
    whole = of[:-2] == of[2:]
    places = (of[:-2][whole] << BITS) | (h[whole] >> np.uint32(32 - BITS))
    return np.bincount(places, minlength=texts << BITS).reshape(texts, 1 << BITS).astype(np.float64)


def term_blocks(column) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, damped term counts) for blocks of texts; a long text is read in pieces."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    shares = np.zeros((rows, 2))
    for row, counts, hashes in word_groups(column, SPACED):
        bounds = starts_of(counts)
        for i in np.flatnonzero(counts):
            words = hashes[bounds[i]:bounds[i + 1]]
            shares[row + i] = (words[1:] == words[:-1]).sum() / len(words), 1 - len(np.unique(words)) / len(words)
    row = 0
    while row < rows:
        stop = min(row + BLOCK_ROWS, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        stop = max(stop, row + 1)
        low, high = int(offsets[row]), int(offsets[stop])
        if high - low <= PIECE_BYTES:
            grams = _gram_counts(data[low:high], offsets[row:stop + 1] - low)
        else:
            grams = sum(_gram_counts(part, np.array([0, len(part)])) for part in
                        (data[a:min(a + PIECE_BYTES + 2, high)] for a in range(low, high, PIECE_BYTES)))
        steps = [shares[row:stop, [i]] > (np.arange(STEPS) + 0.5) / STEPS for i in range(2)]
        yield row, np.concatenate([np.log1p(grams), *steps], axis=1).astype(np.float32)
        row = stop


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighted(terms: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    out = terms * rarity
    out[:, :1 << BITS] = _unit(out[:, :1 << BITS])
    return _unit(out)


def fit(terms: np.ndarray, labels: np.ndarray, dims: int) -> Model:
    """The latent space of the sample, by randomised subspace iteration."""
    rarity = np.log((1 + len(terms)) / (1 + (terms[:, :1 << BITS] > 0).sum(axis=0)))
    rarity = np.append(rarity, np.full(2 * STEPS, STEP_WEIGHT)).astype(np.float32)
    rows = _weighted(terms, rarity)
    basis = np.random.default_rng(1).standard_normal((rows.shape[1], dims + 10)).astype(np.float32)
    for _ in range(3):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :dims].astype(np.float32)
    return Model(rarity, axes, _unit(rows @ axes).astype(np.float32), labels.astype(np.float32))


def vote(terms: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the nearest labelled vectors, weighted by similarity;
    the share in the whole sample where nothing is similar."""
    near = _unit(_weighted(terms, model.rarity) @ model.axes) @ model.vectors.T
    prior = float(model.labels.mean())
    if near.shape[1] > neighbours:
        which = np.argpartition(-near, neighbours, axis=1)[:, :neighbours]
    else:
        which = np.broadcast_to(np.arange(near.shape[1]), near.shape)
    weight = np.maximum(np.take_along_axis(near, which, axis=1), 0).astype(np.float64) ** POWER
    return ((weight * model.labels[which]).sum(axis=1) + 1e-3 * prior) / (weight.sum(axis=1) + 1e-3)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAINING_ROWS, dims: int = DIMS) -> Model | None:
    """The space and the labelled vectors of documents not held out (crc32 modulo 5 is 0).

    ``rows`` bounds the sample, and a row is TERMS numbers of two bytes however long its
    text, so that the decomposition is one small task. None without labelled rows.
    """
    wanted = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (bucket_of(F.col(doc_id), 5) != 0))
              .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
              .withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(rows))
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("words")).join(F.broadcast(wanted), "id").select(
        "place", "label", "words")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, terms in term_blocks(batch.column(2)):
                packed = [x.tobytes() for x in terms.astype("<f2")]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(row, len(packed)) for c in batch.columns[:2]), pa.array(packed, pa.binary())],
                    names=["place", "label", "terms"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, labels_ = [], []
        for batch in batches:
            terms += [np.frombuffer(x, "<f2") for x in batch.column(2).to_pylist()]
            labels_.append(batch.column(1).to_numpy())
        if terms:
            terms = np.stack(terms).astype(np.float32)
            model = fit(terms, np.concatenate(labels_), min(dims, len(terms)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype("<f4").tobytes()]) for x in model], names=["rarity", "axes", "vectors", "labels"])

    found = (sample.mapInArrow(counted, "place long, label int, terms binary").repartition(1)
             .sortWithinPartitions("place", "terms")
             .mapInArrow(fitted, "rarity binary, axes binary, vectors binary, labels binary").first())
    if found is None:
        return None
    rarity, axes, vectors, labels_ = (np.frombuffer(x, "<f4") for x in found)
    return Model(rarity, axes.reshape(TERMS, -1), vectors.reshape(len(labels_), -1), labels_)


def score(docs: DataFrame, model: Model | None, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the voted score of each whole text; null counts as empty, and a missing
    model scores 0.5. If ``docs`` has a column ``to`` already, it stays and the new one gets
    underscores at its end. Texts are read and scored where they are; nothing is shuffled."""
    to = spare(docs, to)
    if model is None:
        return docs.withColumn(to, F.lit(0.5))
    names, hidden = docs.columns, spare(docs, "made")
    at = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(terms, sent.value) for _, terms in term_blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(votes) if votes else np.zeros(0))], names=[*names, hidden])

    scored = docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(hidden)).schema)
    return scored.withColumnRenamed(hidden, to) if to != hidden else scored
