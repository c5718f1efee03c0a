"""Toxicity by logistic regression, trained with FTRL-proximal over hashed n-grams.

Features are the distinct words, word pairs and pairs with one word between of a whole
text, hashed into 2**bits places. Every place has its own learning rate, and L1 keeps
all but a few thousand weights at zero, so the model is two short arrays that go to the
workers; its size is bounded by 2**bits whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.tables import bucket_of, spare
from pagelore.llm.words import PLAIN_LOWER, mix, starts_of, word_groups

BITS = 20
#: At most this many labelled rows are learnt from: those whose ids hash lowest.
TRAINING_ROWS = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1


class Model(NamedTuple):
    bits: int
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float64)
        out[self.places] = self.weights
        return out


def features(column, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, places): the distinct feature places of each text of a group, in order."""
    shift = np.uint64(64 - bits)
    for row, counts, hashes in word_groups(column, PLAIN_LOWER):
        of = np.repeat(np.arange(len(counts)), counts)
        found = [(of << bits) | (hashes >> shift).astype(np.int64)]
        for gap, times in ((1, 3), (2, 5)):
            pair = mix(hashes[:-gap] * np.uint64(times) + hashes[gap:])
            same = of[:-gap] == of[gap:]
            found.append((of[:-gap][same] << bits) | (pair[same] >> shift).astype(np.int64))
        places = np.unique(np.concatenate(found))
        yield row, np.searchsorted(places, np.arange(len(counts) + 1) << bits), places & ((1 << bits) - 1)


class Learner:
    """FTRL-proximal: state z and n of every place, weights made from them when needed."""

    def __init__(self, bits: int):
        self.z, self.n, self.bias, self.seen = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, label: int) -> None:
        z, n = self.z[places], self.n[places]
        w = self.weights(z, n)
        error = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30))) - label
        if abs(error) < 1e-4:
            return
        more = n + error * error
        self.z[places] = z + error - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[places] = more
        self.seen += error * error
        self.bias -= 0.1 * error / np.sqrt(self.seen)


def packed(places: pa.BinaryArray, labels: pa.Int32Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bounds, labels) of a batch: its places in one array of its own, so that the batch can go."""
    bounds = np.frombuffer(places.buffers()[1], np.int32)[places.offset:places.offset + len(places) + 1] // 4
    data = places.buffers()[2]
    flat = np.frombuffer(data, "<u4", len(data) // 4) if data is not None else np.zeros(0, np.uint32)
    return (flat[bounds[0]:bounds[-1]].copy(), bounds - bounds[0], labels.to_numpy().copy()) if len(places) else (flat[:0], bounds[:0], labels.to_numpy())


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAINING_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> Model:
    """A model from labelled documents whose id is not held out (crc32 modulo 5 is 0).

    ``rows`` bounds the sample, so that it may go to one task: texts become feature places
    where they are read, and one learner sees them in the order of a hash of their ids.
    Without labelled rows the model scores every text 0.5.
    """
    wanted = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (bucket_of(F.col(doc_id), 5) != 0))
              .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
              .withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(rows))
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("words")).join(F.broadcast(wanted), "id").select(
        "place", "id", "label", "words")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bounds, places in features(batch.column(3), bits):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(row, n) for c in batch.columns[:3]),
                     pa.array([places[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])])],
                    names=["place", "id", "label", "places"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [packed(b.column(3), b.column(2)) for b in batches]
        learner = Learner(bits)
        for _ in range(epochs):
            for places, bounds, labels_ in seen:
                for y, low, high in zip(labels_, bounds, bounds[1:]):
                    learner.learn(places[low:high], y)
        weights = learner.weights(learner.z, learner.n)
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kept.astype("<u4").tobytes()]), pa.array([weights[kept].astype("<f8").tobytes()]),
             pa.array([float(learner.bias)])], names=["places", "weights", "bias"])

    schema = sample.schema
    places = sample.mapInArrow(hashed, f"place long, id {schema['id'].dataType.simpleString()}, label int, places binary")
    model = (places.repartition(1).sortWithinPartitions("place", "id", "places")
             .mapInArrow(learnt, "places binary, weights binary, bias double").first())
    if model is None:
        return Model(bits, np.zeros(0, np.uint32), np.zeros(0), 0.0)
    return Model(bits, np.frombuffer(model["places"], "<u4"), np.frombuffer(model["weights"], "<f8"), model["bias"])


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; null counts as empty. If
    ``docs`` has a column ``to`` already, it stays and the new one gets underscores at its end.

    Texts are read and scored where they are; nothing is shuffled.
    """
    to = spare(docs, to)
    names, hidden = docs.columns, spare(docs, "made")
    at = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value.dense(), sent.value.bias
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for row, bounds, places in features(batch.column(at), sent.value.bits):
                sums = np.concatenate([[0.0], np.cumsum(weights[places])])
                out[row:row + len(bounds) - 1] += sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names=[*names, hidden])

    scored = docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(hidden)).schema)
    return scored.withColumnRenamed(hidden, to) if to != hidden else scored


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score is below ``threshold``, by a model learnt from them and ``labels``."""
    model = train(docs, labels, doc_id, text)
    mark = spare(docs, "score")
    return score(docs, model, text, mark).where(F.col(mark) < threshold).drop(mark)
