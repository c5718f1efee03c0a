"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words and word pairs of all training texts are counted in Spark, by hash and in packed
blocks. A count c is kept as its level 1 + floor(log2 c): the n-gram is entered in the
filter once for every level up to its own, and is read by probing level after level
until one is missing. Each bucket of hashes has a segment of the filter, sized by its
entries, so the filter grows with the corpus. It is never gathered: segments stay rows
of a table by bucket, with the exact counts of the bucket's words. Texts are dealt into
groups of about GROUP_BYTES; each group asks every bucket, in packed blocks, for the
counts of its words and the levels of its pairs, and is scored when the answers are back.
The share of set bits says how often a probe errs; a pair's count is believed that much less.

Words that make up at least 1 / FREQUENT of all tokens (so at most FREQUENT of them) go
to the workers and are not asked for. That saves questions and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelore.llm.tables import bucket_of, saved
from pagelore.llm.words import SPACED_LOWER, mix, starts_of, word_groups

ENTRY_BITS, PROBES = 8, 3
FREQUENT = 1 << 20
GROUP_BYTES = 4 << 20
PRIOR = 200.0
_END = np.uint64(0xE5D1A6C37F204B99)
_PAIR_BYTES = 5
_PAIR_MASK = np.uint64((1 << 8 * _PAIR_BYTES) - 1)
_DECODED = np.concatenate([[0.0, 1.0], 1.4 * 2.0 ** np.arange(1, 63)])


class Known(NamedTuple):
    words: np.ndarray       # hashes of frequent words, ascending
    counts: np.ndarray
    slots: np.ndarray       # where each prefix of word hashes begins


@dataclass
class Model:
    tokens: int
    types: int
    known: Known
    trust: float            # share of absent n-grams that a probe finds absent
    buckets: int
    table: DataFrame        # per bucket: words, their counts and the filter segment

    @cached_property
    def gathered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The whole filter on the driver, for small models: bits, first bit and number of bits of each segment."""
        parts = self.table.select("bucket", "size", "segment").toArrow()
        sizes = np.full(self.buckets, 64, np.uint64)
        sizes[parts.column("bucket").to_numpy()] = parts.column("size").to_numpy()
        starts = np.append(0, np.cumsum(sizes))[:-1].astype(np.uint64)
        bits = np.zeros(int(sizes.sum()) // 8, np.uint8)
        for bucket, segment in zip(parts.column("bucket").to_pylist(), parts.column("segment")):
            low = int(starts[bucket]) // 8
            bits[low:low + int(sizes[bucket]) // 8] = np.frombuffer(segment.as_buffer(), np.uint8)
        return bits, starts, sizes

    @property
    def bits(self) -> np.ndarray:
        return self.gathered[0]

    @property
    def sizes(self) -> np.ndarray:
        return self.gathered[2]


def token_groups(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens of each row, hashes) of groups of texts; each text ends in an end token."""
    for row, counts, hashes in word_groups(column, SPACED_LOWER):
        yield row, counts + 1, np.insert(hashes, np.cumsum(counts), _END)


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """The hash of every token with the one before; a text begins after an end token."""
    return mix(np.append(_END, tokens[:-1]) * np.uint64(3) + tokens)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(8 * _PAIR_BYTES)) % np.uint64(buckets)).astype(np.int64)


def _buckets(docs: DataFrame) -> int:
    return max(256, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _packed(hashes: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpacked(parts: list[bytes], size: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _counted(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[:len(ordered)]
    return ordered[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def _positions(keys: np.ndarray, level: int, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The filter bits of an entry: PROBES places in the segment of its bucket."""
    x = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    for _ in range(PROBES):
        yield starts + ((high * sizes) >> np.uint64(32))
        high = (high + low) & np.uint64(0xFFFFFFFF)


def _keys(hashes: np.ndarray, order: int) -> np.ndarray:
    return mix((hashes & _PAIR_MASK) | np.uint64(order << 60))


def _segment(keys: np.ndarray, counts: np.ndarray, most: int | None) -> tuple[bytes, int, int]:
    """(bits, their number, set ones) of a bucket's part of the filter."""
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    size = max(64, -(-ENTRY_BITS * int(levels.sum()) // 64) * 64)
    size = size if most is None else min(most, size)
    bits = np.zeros(size, bool)
    zero, whole = np.uint64(0), np.uint64(size)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _positions(keys[levels >= level], level, zero, whole):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes(), size, int(bits.sum())


def count_ngrams(docs: DataFrame, text: str = "text", filter_bytes: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per bucket: its words with exact counts, and its filter segment of words and pairs."""
    buckets = buckets or _buckets(docs)
    most = None if filter_bytes is None else max(64, filter_bytes * 8 // buckets // 64 * 64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [t for _, _, t in token_groups(batch.column(0))]
            if not tokens:
                continue
            for order, size, hashes in ((1, 8, np.concatenate(tokens)), (2, _PAIR_BYTES, np.concatenate([pairs_of(t) for t in tokens]))):
                hashes, times = np.unique(hashes, return_counts=True)
                bucket = _bucket(hashes, buckets)
                by = np.argsort(bucket, kind="stable")
                packed, counts = _packed(hashes[by], size), times[by].astype("<u4").tobytes()
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
                some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([order] * len(some), pa.int32()),
                     pa.array([packed[size * cuts[b]:size * cuts[b + 1]] for b in some], pa.binary()),
                     pa.array([counts[4 * cuts[b]:4 * cuts[b + 1]] for b in some], pa.binary())],
                    names=["bucket", "n", "hashes", "times"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            words, pairs = ([(h, t) for n, h, t in zip(*(c.to_pylist() for c in rows.columns[1:])) if n == order] for order in (1, 2))
            found = []
            for parts, size in ((words, 8), (pairs, _PAIR_BYTES)):
                times = np.frombuffer(b"".join(t for _, t in parts), "<u4").astype(np.int64)
                found.append(_counted(_unpacked([h for h, _ in parts], size), times))
            (word, count), (pair, times) = found
            segment, size, ones = _segment(np.concatenate([_keys(word, 1), _keys(pair, 2)]), np.concatenate([count, times]), most)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([_packed(word, 8)]), pa.array([count.astype("<i8").tobytes()]),
                 pa.array([int(count.sum())]), pa.array([len(word)]), pa.array([segment]), pa.array([size]), pa.array([ones])],
                names=["bucket", "words", "counts", "tokens", "types", "segment", "size", "ones"])

    rows = docs.select(text).mapInArrow(blocks, "bucket int, n int, hashes binary, times binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        settled, "bucket int, words binary, counts binary, tokens long, types long, segment binary, size long, ones long")


def by_bucket(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one bucket at a time, of batches in the order of column ``at``."""
    waiting: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        keys = batch.column(at).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist() if len(keys) else [0]
        for low, high in zip(cuts, cuts[1:]):
            if waiting and keys[low] != name:
                yield name, pa.Table.from_batches(waiting)
                waiting = []
            name = int(keys[low])
            waiting.append(batch.slice(low, high - low))
    if waiting:
        yield name, pa.Table.from_batches(waiting)


def fit(docs: DataFrame, text: str = "text", filter_bytes: int | None = None, buckets: int | None = None) -> Model:
    """The model of all ``docs``. What reaches the driver is bounded: totals, and the frequent
    words by FREQUENT. The filter takes what its entries need unless ``filter_bytes`` limits it."""
    buckets = buckets or _buckets(docs)
    table = saved(count_ngrams(docs, text, filter_bytes, buckets), "ngrams")
    total = table.agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "size", "ones"))).first()
    tokens, types = total["tokens"] or 0, total["types"] or 0
    least = max(1, -(-tokens // FREQUENT))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = np.frombuffer(counts, "<i8")
                some = count >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(words, "<i8")[some]), pa.array(count[some])], names=["word", "count"])

    known = table.select("words", "counts").mapInArrow(frequent, "word long, count long").toArrow()
    words, counts = known.column(0).to_numpy().view(np.uint64), known.column(1).to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    slots = np.searchsorted(words, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
    filled = (total["ones"] or 0) / max(1, total["size"] or 0)
    return Model(tokens, types, Known(words, counts, slots), 1 - filled ** PROBES, buckets, table)


def _levels(bits: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.uint8)
    at = np.arange(len(keys))
    for level in range(1, len(_DECODED)):
        here = np.ones(len(at), bool)
        for place in _positions(keys, level, starts, sizes):
            here &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, keys, starts, sizes = at[here], keys[here], starts[here], sizes[here]
        if not len(at):
            break
        out[at] = level
    return out


def levels(model: Model, hashes: np.ndarray, order: int) -> np.ndarray:
    """The level of each n-gram in the gathered filter: probes go on until one finds nothing."""
    bits, starts, sizes = model.gathered
    bucket = _bucket(hashes, model.buckets)
    return _levels(bits, _keys(hashes, order), starts[bucket], sizes[bucket])


def known_counts(known: Known, hashes: np.ndarray) -> np.ndarray:
    """Exact counts of frequent words; 0 for every other."""
    out = np.zeros(len(hashes), np.int64)
    place = known.slots[(hashes >> np.uint64(44)).astype(np.int64)].astype(np.int64)
    at = np.flatnonzero(place < len(known.words))
    while len(at):
        here = known.words[place[at]]
        same = here == hashes[at]
        out[at[same]] = known.counts[place[at[same]]]
        at = at[here < hashes[at]]
        place[at] += 1
        at = at[place[at] < len(known.words)]
    return out


def log_probabilities(tokens: int, types: int, trust: float, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each token's probability after the one before, from exact counts and pair levels
    of whole texts: the pair's count smoothed by PRIOR pseudo-counts of the word's own share,
    as far as the filter can be trusted."""
    alone = (counts + 1) / (tokens + types + 1)
    context = np.append(counts[-1:], counts[:-1]).astype(np.float64)   # the last token is an end, as the one before the first
    after = (np.minimum(_DECODED[pairs], context) + PRIOR * alone) / (context + PRIOR)
    return np.log10(trust * after + (1 - trust) * alone)


class Asked(NamedTuple):
    hashes: np.ndarray      # distinct ones, by bucket
    cuts: np.ndarray        # where each bucket begins
    places: np.ndarray      # of every n-gram among ``hashes``

    @classmethod
    def of(cls, hashes: np.ndarray, buckets: int) -> Asked:
        found, which = np.unique(hashes, return_inverse=True)
        bucket = _bucket(found, buckets)
        by = np.argsort(bucket, kind="stable")
        places = np.empty(len(by), np.int64)
        places[by] = np.arange(len(by))
        return cls(found[by], np.searchsorted(bucket[by], np.arange(buckets + 1)), places[which])


class Group(NamedTuple):
    sizes: np.ndarray       # tokens of each text
    counts: np.ndarray      # of each token, where it is frequent
    rare: np.ndarray        # places of other tokens
    words: Asked
    pairs: Asked

    @classmethod
    def of(cls, column, known: Known, buckets: int) -> Group:
        """What the texts of a group must ask for: the same for the same texts."""
        parts = [(sizes, tokens, pairs_of(tokens)) for _, sizes, tokens in token_groups(column)]
        sizes, tokens, pairs = (np.concatenate(x) for x in zip(*parts))
        counts = known_counts(known, tokens)
        rare = np.flatnonzero(counts == 0)
        return cls(sizes, counts, rare, Asked.of(tokens[rare], buckets), Asked.of(pairs, buckets))


def _answered(table: DataFrame, asks: DataFrame) -> DataFrame:
    """(group, bucket, counts, levels): what each bucket's row of ``table`` knows of the words and pairs in ``asks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            bucket, group = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < len(bucket):
                if group[at] < 0:
                    words, _, counts, segment, size = (batch.column(i)[at].as_py() for i in range(2, 7))
                    own = int(bucket[at]), np.frombuffer(words, "<u8"), np.frombuffer(counts, "<i8"), np.frombuffer(segment, np.uint8), size
                    at += 1
                    continue
                stop = at + int(np.searchsorted(bucket[at:], bucket[at], "right"))
                words, pairs = (batch.column(i).slice(at, stop - at).to_pylist() for i in (2, 3))
                word, pair = np.frombuffer(b"".join(words), "<u8"), _unpacked(pairs, _PAIR_BYTES)
                count, level = np.zeros(len(word), "<u8"), np.zeros(len(pair), np.uint8)
                if own is not None and own[0] == bucket[at]:
                    _, there, counts, bits, size = own
                    if len(there) and len(word):
                        place = np.minimum(np.searchsorted(there, word), len(there) - 1)
                        count[:] = np.where(there[place] == word, counts[place], 0)
                    if len(pair):
                        level = _levels(bits, _keys(pair, 2), np.zeros(len(pair), np.uint64), np.full(len(pair), size, np.uint64))
                count, level = count.tobytes(), level.tobytes()
                w, p = (starts_of(np.array([len(x) // n for x in some])).tolist() for some, n in ((words, 8), (pairs, _PAIR_BYTES)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, stop - at), batch.column(0).slice(at, stop - at),
                     pa.array([count[8 * a:8 * b] for a, b in zip(w, w[1:])], pa.binary()),
                     pa.array([level[a:b] for a, b in zip(p, p[1:])], pa.binary())], names=["group", "bucket", "counts", "levels"])
                at = stop

    nothing = F.lit(None).cast("binary")
    have = table.select("bucket", F.lit(-1).cast("long").alias("group"), "words", nothing.alias("pairs"), "counts", "segment", "size")
    want = asks.select("bucket", "group", "words", "pairs", nothing.alias("counts"), nothing.alias("segment"), F.lit(None).cast("long").alias("size"))
    return have.unionAll(want).repartition("bucket").sortWithinPartitions("bucket", "group").mapInArrow(
        run, "group long, bucket int, counts binary, levels binary")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_tokens, n_known, train_tokens, base_score and score.

    Words are those between ASCII white space, A-Z in lower case; a null text is empty, and
    every text ends in one end token. Repeated rows are scored as rows of their own.
    """
    kept = [c for c in docs.columns if c != text]
    tokens, types, trust, buckets = model.tokens, model.types, model.trust, model.buckets
    sent = docs.sparkSession.sparkContext.broadcast(model.known)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    rows = max(1, total["n"] * GROUP_BYTES // max(1, total["bytes"] or 0))
    head = [f"k{i}" for i in range(len(kept))]
    inner = docs.select(*(F.col(c).alias(k) for c, k in zip(kept, head)), F.col(text).alias("text"),
                        F.expr(f"monotonically_increasing_id() div {rows}").alias("group"))

    def asking(texts: pa.Table) -> pa.Table:
        group = Group.of(texts.column("text"), sent.value, buckets)
        words, pairs = (x.cuts.tolist() for x in (group.words, group.pairs))
        some = [b for b in range(buckets) if words[b + 1] > words[b] or pairs[b + 1] > pairs[b]]
        blocks = [pa.array([packed[n * cuts[b]:n * cuts[b + 1]] for b in some], pa.binary()) for packed, n, cuts in (
            (_packed(group.words.hashes, 8), 8, words), (_packed(group.pairs.hashes, _PAIR_BYTES), _PAIR_BYTES, pairs))]
        name = texts.column("group")[0].as_py()
        return pa.table([pa.array([name] * len(some), pa.int64()), pa.array(some, pa.int32()), *blocks], names=["group", "bucket", "words", "pairs"])

    def scoring(texts: pa.Table, answers: pa.Table) -> pa.Table:
        group, answers = Group.of(texts.column("text"), sent.value, buckets), answers.sort_by("bucket")
        counts, levels_ = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t) for c, t in (("counts", "<u8"), ("levels", np.uint8)))
        if len(counts) != len(group.words.hashes) or len(levels_) != len(group.pairs.hashes):
            raise RuntimeError("the answers are not those to this group's questions")
        group.counts[group.rare] = counts[group.words.places]
        begins = starts_of(group.sizes)[:-1]
        value = log_probabilities(tokens, types, trust, group.counts, levels_[group.pairs.places])
        made = (group.sizes, np.add.reduceat(group.counts > 0, begins, dtype=np.int64),
                np.add.reduceat(np.log10(group.counts + 1.0), begins), np.add.reduceat(value, begins))
        return pa.table([*(texts.column(k) for k in head), *map(pa.array, made)], names=[*head, "n_tokens", "n_known", "base", "score"])

    answers = _answered(model.table, inner.groupBy("group").applyInArrow(asking, "group long, bucket int, words binary, pairs binary"))
    schema = StructType(inner.select(*head).schema.fields).add("n_tokens", "long").add("n_known", "long").add("base", "double").add("score", "double")
    whole = inner.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(scoring, schema)
    scale = F.log10(F.lit(float(tokens + types + 1)))
    return whole.select(
        *(F.col(k).alias(c) for c, k in zip(kept, head)), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), "score")


def score_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, part: int = 2,
                   filter_bytes: int | None = None) -> DataFrame:
    """Scores of all ``docs`` by the model of those whose crc32(id) modulo ``parts`` is not ``part``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (bucket_of(F.col(doc_id), parts) == part).alias("held_out"),
                       F.col(text).alias("text"))
    model = fit(rows.where("not held_out"), "text", filter_bytes)
    return score(rows, model)
