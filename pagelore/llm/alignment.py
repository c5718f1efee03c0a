"""Alignment of two tokenizers' tokens over the bytes of the same texts, by interval coalescing.

Tokens are byte intervals. All intervals of A and B are sorted together by start
(``lexsort``), a running maximum of the ends (``maximum.accumulate``) follows, and a group
begins where a start has reached it. Inside the groups overlapping pairs are expanded;
those that end together are links.

A space between two characters that are no white space is a forced cut of both
tokenizers: A's splitting pattern begins a word there, and no piece of B has a space after
another character. Texts are cut there, the segments are aligned on their own, many side
by side, and their groups are concatenated. Segments seen before are remembered.

Two tokens that end together are a suffix of one another, so all pairs that can ever be
linked follow from the two vocabularies and are numbered once. Their counts are one array
of that length however large the corpus is; it is added up by Spark and broadcast.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.llm.bpe import byte_symbols
from pagelore.llm.tables import spare
from pagelore.llm.words import starts_of

#: Segments in each of a worker's two memories, and the longest that is remembered.
REMEMBERED, REMEMBERED_CHARS = 150_000, 256
#: Characters of new segments aligned at once, and of results sent at once.
BLOCK_CHARS, OUT_BYTES = 1 << 18, 1 << 21
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((i for row in rows for i in row), np.int64, int(counts.sum())), counts


class Pair:
    """Both tokenizers, the bytes of their entries, and all pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {s: i for i, s in enumerate(byte_symbols())}
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["id"] for x in spec["added_tokens"]}
        words = {i: t for t, i in spec["model"]["vocab"].items() if i not in special}
        self.a_bytes = [bytes(byte[c] for c in words[i]) if i in words else b"" for i in range(max([*words, *special]) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(" " in p.lstrip(" ") for p in (x.decode("utf-8", "replace") for x in self.b_bytes)):
            raise ValueError("a piece of B goes on after a space, so spaces are no forced cuts")
        self.keys = self._linkable()
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        widest = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = np.array([[f"{i}{mark}" for i in range(widest)] for mark in ",|;\n"], object)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _linkable(self) -> np.ndarray:
        """a << 32 | b of all entries of which one is a suffix of the other, ascending."""
        sides: list[dict[bytes, list[int]]] = [{}, {}]
        for side, entries in zip(sides, (self.a_bytes, self.b_bytes)):
            for i, entry in enumerate(entries):
                if entry:
                    side.setdefault(entry, []).append(i)
        a_of, b_of = sides
        found = {i << 32 | j for x, many in a_of.items() for k in range(len(x)) for j in b_of.get(x[k:], ()) for i in many}
        found |= {i << 32 | j for x, many in b_of.items() for k in range(len(x)) for i in a_of.get(x[k:], ()) for j in many}
        return np.array(sorted(found), np.int64)

    def _spelled(self, raw: list[bytes], a_ids: np.ndarray, a_counts: np.ndarray, b_ids: np.ndarray, b_counts: np.ndarray) -> list[bool]:
        """Whether the tokens of both sides spell each segment; one comparison where all do."""
        sides = []
        for ids, counts, entries, sizes in ((a_ids, a_counts, self.a_bytes, self.a_sizes), (b_ids, b_counts, self.b_bytes, self.b_sizes)):
            sides.append((b"".join(map(entries.__getitem__, ids.tolist())), starts_of(sizes[ids])[starts_of(counts)].tolist()))
        (a, a_at), (b, b_at) = sides
        if a == b == b"".join(raw) and a_at == b_at == starts_of(np.fromiter(map(len, raw), np.int64, len(raw))).tolist():
            return [True] * len(raw)
        return [a[i:j] == r == b[k:m] for r, i, j, k, m in zip(raw, a_at, a_at[1:], b_at, b_at[1:])]

    def align(self, segments: list[str]) -> list[tuple | None]:
        """(groups, link numbers, n_a, n_b, n_groups) of each segment with a space before it;
        None where A's or B's bytes are not the segment's."""
        raw = [b" " + s.encode() for s in segments]
        a_rows = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        b_rows = self.b.encode(segments, num_threads=1)
        (a_ids, a_counts), (b_ids, b_counts) = _flat(a_rows), _flat(b_rows)
        same = self._spelled(raw, a_ids, a_counts, b_ids, b_counts)
        if not all(same):
            kept = np.array(same)
            a_ids, b_ids = a_ids[np.repeat(kept, a_counts)], b_ids[np.repeat(kept, b_counts)]
            a_counts, b_counts = a_counts[kept], b_counts[kept]
        if not len(a_ids):
            return [None] * len(segments)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])

        side = np.repeat(np.array([0, 1]), (len(a_ids), len(b_ids)))
        starts, ends, ids = np.append(a_starts, b_starts), np.append(a_ends, b_ends), np.append(a_ids, b_ids)
        order = np.lexsort((side, starts))
        reach = np.maximum.accumulate(ends[order])
        fresh = np.append(True, starts[order][1:] >= reach[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1

        low, high = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
        left = np.repeat(np.arange(len(a_ids)), high - low)
        right = np.arange(len(left)) - np.repeat(starts_of(high - low)[:-1] - low, high - low)
        linked = a_ends[left] == b_ends[right]
        left, right = left[linked], right[linked]
        links = np.searchsorted(self.keys, a_ids[left] << 32 | b_ids[right]).astype("<u4")

        written = np.argsort(group, kind="stable")         # A's tokens of a group, then B's
        last_group = group[np.cumsum(a_counts) - 1]
        mark = np.zeros(len(written), np.int64)            # what follows a token: , | ; or the segment's end
        g, s = group[written], side[written]
        mark[:-1][s[1:] > s[:-1]] = 1
        closes = np.append(g[1:] != g[:-1], True)
        mark[closes] = 2
        mark[np.flatnonzero(closes)[last_group]] = 3
        texts = "".join(self.digits[mark, ids[written]].tolist()).split("\n")

        link_bounds = starts_of(np.bincount(np.searchsorted(np.cumsum(a_counts), left, "right"), minlength=len(a_counts)))
        group_counts = np.diff(np.append(-1, last_group))
        packed = links.tobytes()
        made = iter(zip(texts, link_bounds[:-1].tolist(), link_bounds[1:].tolist(),
                        a_counts.tolist(), b_counts.tolist(), group_counts.tolist()))
        out: list[tuple | None] = []
        for ok in same:
            if not ok:
                out.append(None)
                continue
            text, first, stop, n_a, n_b, n_groups = next(made)
            out.append((text, packed[4 * first:4 * stop], n_a, n_b, n_groups))
        return out

    def lookup(self, segments: list[str]) -> dict[str, tuple | None]:
        """The results of ``segments``. A full memory becomes the older one; what is met again moves on from there."""
        found = dict.fromkeys(segments)
        if len(self.known) + len(found) > REMEMBERED:
            self.older, self.known = self.known, {}
        missing = found.keys() - self.known.keys()
        again = {s: self.older[s] for s in missing & self.older.keys()}
        self.known.update(again)
        new = [s for s in missing if s not in again]
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (stop == at or size + len(new[stop]) <= BLOCK_CHARS):
                size += len(new[stop])
                stop += 1
            self.known.update(zip(new[at:stop], self.align(new[at:stop])))
            at = stop
        return self.known

    def texts(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, groups, links) of whole texts; zeros and empty where they cannot be aligned."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        known = self.lookup([s for row in cut for s in row])
        out = []
        for row in cut:
            parts = list(map(known.__getitem__, row))
            if not parts or None in parts:
                out.append((0, 0, 0, "", b""))
                continue
            groups, links, n_a, n_b, n_groups = zip(*parts)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
        for s in {s for row in cut for s in row if len(s) > REMEMBERED_CHARS}:
            del known[s]
        return out


_loaded: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Pair(a_path, b_path)
    return _loaded[a_path, b_path]


def _parts(texts: list[str]) -> Iterator[slice]:
    """Stretches of ``texts`` of bounded size; a longer text is one of its own."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > BLOCK_CHARS:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    yield slice(at, len(texts))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", to: str = "alignment") -> DataFrame:
    """``docs`` with a struct ``to``: n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``, decimal ids in
    order) and links (numbers of linked pairs, little-endian unsigned 32-bit integers).

    A is a byte-level BPE file read by the tokenizers library, B a sentencepiece model; A gets a
    space and the text, B the text, to which it adds the space. Texts that are null or empty, or
    whose tokens do not spell them, have no tokens: zeros and empty values. Repeated rows stay,
    other columns too; a column called ``to`` is replaced. Both files must be at the same path on
    every worker, as the installed package of tokenizers is.
    """
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
                        + [T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType())])
    kept = docs.drop(to) if to != text else docs
    made = spare(kept, "made")
    at = kept.columns.index(text)
    arrow = [pa.int64()] * 3 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for part in _parts(texts) if texts else ():
                rows = pair.texts(texts[part])
                first, size = 0, 0
                for i, row in enumerate(rows):
                    size += len(row[3]) + len(row[4])
                    if size >= OUT_BYTES or i + 1 == len(rows):
                        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows[first:i + 1]), arrow)]
                        struct = pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, t) for f, t in zip(kind, arrow)])
                        given = batch.slice(part.start + first, i + 1 - first)
                        yield pa.RecordBatch.from_arrays([*given.columns, struct], names=[*given.schema.names, made])
                        first, size = i + 1, 0

    schema = T.StructType([*kept.schema.fields, T.StructField(made, kind)])
    out = kept.mapInArrow(run, schema)
    return (out.drop(to) if to in kept.columns else out).withColumnRenamed(made, to)


def _links(column) -> tuple[np.ndarray, np.ndarray]:
    """All link numbers of a binary column, and where each row's begin and end."""
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    numbers = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view("<u4") if data is not None else np.zeros(0, "<u4")
    return numbers, (offsets - offsets[0]) // 4


def link_counts(links: DataFrame, column: str, a_path: str, b_path: str) -> DataFrame:
    """(link, a_id, b_id, count): how many links of the whole corpus hold each pair. Every task adds
    its rows up in one array over the linkable pairs and sends only the pairs it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _pair(a_path, b_path).keys
        seen = np.zeros(len(keys), np.int64)
        for batch in batches:
            if batch.num_rows:
                numbers, _ = _links(batch.column(0))
                seen += np.bincount(numbers, minlength=len(keys))
        found = np.flatnonzero(seen)
        for i in range(0, len(found), 1 << 16):
            part = found[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys[part] >> 32), pa.array(keys[part] & 0xFFFFFFFF),
                                              pa.array(seen[part])], names=["link", "a_id", "b_id", "n"])

    parts = links.select(column).mapInArrow(run, "link long, a_id long, b_id long, n long")
    return parts.groupBy("link", "a_id", "b_id").agg(F.sum("n").alias("count"))


def link_scores(links: DataFrame, column: str, counts: DataFrame, best: str = "n_best", total: str = "count_sum") -> DataFrame:
    """``links`` with the number of links whose count is the highest of their B id (ties included),
    and the sum of the counts. ``counts`` has at most as many rows as there are linkable pairs."""
    spark = links.sparkSession
    given = counts.select("link", "b_id", "count").toArrow()
    link, b_id, count = (given.column(i).to_numpy() for i in range(3))
    size = int(link.max()) + 1 if len(link) else 0
    table, top = np.zeros(size, np.int64), np.zeros(size, bool)
    highest = np.zeros(int(b_id.max()) + 1 if size else 0, np.int64)
    np.maximum.at(highest, b_id, count)
    table[link], top[link] = count, count == highest[b_id]
    sent = spark.sparkContext.broadcast((table, top))
    at = links.columns.index(column)
    names = [spare(links, best), spare(links, total)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = sent.value
        for batch in batches:
            sums = [np.zeros(0, np.int64)] * 2
            if batch.num_rows:
                numbers, bounds = _links(batch.column(at))
                sums = [np.diff(starts_of(x[numbers].astype(np.int64))[bounds]) for x in (top, table)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], names=[*batch.schema.names, *names])

    schema = T.StructType([*links.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return links.mapInArrow(run, schema)
