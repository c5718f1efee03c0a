"""Prefix trie of conversations as balanced parentheses, shard by shard.

Rebuilt conversations are sorted by their turns and dealt into ranges. A shard writes its part
of the trie as parentheses, an opening one where a node begins and a closing one after its
subtree. The excess (open minus closed) is kept with its minimum and maximum for every block
and for a tree over the blocks; ``findclose`` looks in the node's block, then climbs and
descends that tree. Between a parenthesis and its partner lie the subtree's leaves (``()``
pairs, counted by rank), conversations and savings, read off cumulative arrays.

Only nodes on the first or last path of a shard, its spine, can lie in several shards. They
are merged by the hash of their path: counts add up, what hangs below is summed along the
spines, each spine node counting in one shard only. Everything else is finished in its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.tables import dropped, saved

KEY = 16
#: Turns of a shard; a longer conversation is a shard of its own.
SHARD_TURNS = 1 << 15
BLOCK = 64
NONE = np.iinfo(np.int64).max
_FAMILY, _HEADS = 100, 6

_NODES = """kind int, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long,
 n_leaves long, saved_tokens long, ends_sha256 string, key binary, shard long, place long, branch int, n_chars long, ends string"""


class Parentheses:
    """A balanced sequence (True opens) with range min-max blocks over its excess."""

    def __init__(self, parens: np.ndarray):
        self.parens = parens
        self.excess = np.cumsum(np.where(parens, 1, -1))
        blocks = -(-len(parens) // BLOCK)
        self.leaves = 1 << max(blocks - 1, 0).bit_length()
        padded = np.full(self.leaves * BLOCK, NONE)
        padded[:len(parens)] = self.excess
        self.padded = padded.reshape(self.leaves, BLOCK)
        self.low = np.full(2 * self.leaves, NONE)
        self.low[self.leaves:] = self.padded.min(axis=1)
        self.high = np.full(2 * self.leaves, -NONE)
        self.high[self.leaves:] = np.where(self.padded == NONE, -NONE, self.padded).max(axis=1)
        first = self.leaves
        while first > 1:
            half = first // 2
            self.low[half:first] = self.low[first:2 * first].reshape(half, 2).min(axis=1)
            self.high[half:first] = self.high[first:2 * first].reshape(half, 2).max(axis=1)
            first = half

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place in each block of the first excess ``target`` behind ``after``; BLOCK where there is none."""
        out = np.empty(len(block), np.int64)
        for i in range(0, len(block), 1 << 14):
            part = slice(i, i + (1 << 14))
            hit = (self.padded[block[part]] == target[part, None]) & (np.arange(BLOCK) > after[part, None])
            out[part] = np.where(hit.any(axis=1), hit.argmax(axis=1), BLOCK)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of every opening one: the first later place of the excess before it."""
        target = self.excess[opens] - 1
        block, at = opens // BLOCK, opens % BLOCK
        found = self._in_block(block, at, target)
        close = block * BLOCK + found
        rest = np.flatnonzero(found == BLOCK)
        node = block[rest] + self.leaves
        climbing = np.arange(len(rest))
        while len(climbing):                       # up, until the right sibling reaches the target
            here = node[climbing]
            sibling = here + 1
            wanted = target[rest[climbing]]
            reached = (here % 2 == 0) & (self.low[np.minimum(sibling, len(self.low) - 1)] <= wanted)
            node[climbing] = np.where(reached, sibling, here // 2)
            climbing = climbing[~reached]
        falling = np.flatnonzero(node < self.leaves)
        while len(falling):                        # down to the first block that reaches it
            left = 2 * node[falling]
            inside = (self.low[left] <= target[rest[falling]]) & (self.high[left] >= target[rest[falling]])
            node[falling] = np.where(inside, left, left + 1)
            falling = falling[node[falling] < self.leaves]
        block = node - self.leaves
        close[rest] = block * BLOCK + self._in_block(block, np.full(len(rest), -1), target[rest])
        return close


def _range_min(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The minimum of every non-empty range, one doubled level in memory at a time."""
    out = np.empty(len(starts), np.int64)
    level = np.frexp((stops - starts).astype(np.float64))[1] - 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(values[starts[at]], values[stops[at] - (1 << k)])
        if len(values) > 1 << k:
            values = np.minimum(values[:-(1 << k)], values[1 << k:])
    return out


def _common(keys: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Turns that each path shares with the one before it; 0 for the first."""
    out = np.zeros(len(depths), np.int64)
    both = np.minimum(depths[1:], depths[:-1])
    bounds = np.append(0, np.cumsum(depths))
    some = np.flatnonzero(both)
    if len(some):
        size = both[some]
        at = np.append(0, np.cumsum(size))
        step = np.arange(at[-1]) - np.repeat(at[:-1], size)
        same = (keys[np.repeat(bounds[some], size) + step] == keys[np.repeat(bounds[some + 1], size) + step]).all(axis=1)
        out[some + 1] = np.minimum.reduceat(np.where(same, np.repeat(size, size), step), at[:-1])
    return out


def _path_keys(path: bytes) -> list[bytes]:
    """The hash of every prefix of a path, from the empty one on."""
    digest = hashlib.sha256()
    out = [digest.copy().digest()[:KEY]]
    for i in range(0, len(path), KEY):
        digest.update(path[i:i + KEY])
        out.append(digest.copy().digest()[:KEY])
    return out


def _joined(convs: np.ndarray) -> str:
    return ",".join(map(str, convs.tolist()))


def shard_nodes(paths: list[bytes], lens: np.ndarray, convs: np.ndarray, shard: int) -> pa.RecordBatch:
    """The nodes of sorted conversations: finished ones (kind 0) and those of the spine (kind 1)."""
    keys = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    depths = np.fromiter((len(p) // KEY for p in paths), np.int64, len(paths))
    shared = _common(keys, depths)
    opened = depths - shared
    closed = np.append(0, depths[:-1] - shared[1:])
    runs = np.concatenate([[1], np.stack([closed, opened], axis=1).ravel(), [depths[-1] + 1]])
    kinds = np.concatenate([[True], np.tile([False, True], len(paths)), [False]])
    tree = Parentheses(np.repeat(kinds, runs))

    opens = np.flatnonzero(tree.parens)
    count = len(opens)
    close = tree.findclose(opens)
    rank = np.cumsum(tree.parens)
    stop = rank[close]                                                  # the subtree is nodes v … stop - 1, in preorder
    depth = tree.excess[opens] - 1
    ends_at = np.cumsum(opened)
    step = np.arange(depths.sum()) - np.repeat(np.cumsum(depths) - depths, depths)
    n_chars = np.append(0, lens[step >= np.repeat(shared, depths)])

    def below(per_node: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(per_node))
        return sums[stop] - sums[:-1]

    n_convs = below(np.bincount(ends_at, minlength=count))
    first_end = np.full(count, NONE)
    firsts = np.flatnonzero(np.append(True, ends_at[1:] != ends_at[:-1]))
    first_end[ends_at[firsts]] = convs[firsts]
    least = _range_min(first_end, np.arange(count), stop)

    by_depth = np.sort(depth * count + np.arange(count))
    parent = by_depth[np.searchsorted(by_depth, (depth[1:] - 1) * count + np.arange(1, count)) - 1] % count
    parent = np.append(-1, parent)

    last_path = [int(ends_at[-1])]
    while parent[last_path[-1]] >= 0:
        last_path.append(int(parent[last_path[-1]]))
    last_path.reverse()
    spine = np.zeros(count, bool)
    spine[:depths[0] + 1] = spine[last_path] = True

    pairs = np.append(tree.parens[:-1] & ~tree.parens[1:], False)       # the () pairs
    leaf = pairs[opens] & ~spine
    pair_rank = np.append(0, np.cumsum(pairs & np.isin(np.arange(len(pairs)), opens[leaf], assume_unique=True)))
    n_leaves = pair_rank[close + 1] - pair_rank[opens]
    saved_tokens = below(np.where(spine, 0, (n_convs - 1) * n_chars))
    n_children = np.bincount(parent[1:][~spine[1:]], minlength=count)

    bounds = np.append(firsts, len(convs))
    end_nodes = ends_at[firsts]
    digest = [hashlib.sha256(b"").hexdigest()] * count
    ends = [""] * count
    for node, low, high in zip(end_nodes.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if spine[node]:
            ends[node] = _joined(convs[low:high])
        else:
            digest[node] = hashlib.sha256(_joined(convs[low:high]).encode()).hexdigest()
    key: list[bytes | None] = [None] * count
    for nodes, path in ((range(depths[0] + 1), paths[0]), (last_path, paths[-1])):
        for node, name in zip(nodes, _path_keys(path)):
            key[node] = name
    stem = np.zeros(count, bool)
    stem[[v for v in last_path if v <= depths[0]]] = True
    branch = np.where(stem, 0, np.where(np.arange(count) <= depths[0], 1, 2))
    hangs = np.append(False, spine[parent[1:]])
    spine_parent = [key[p] if h else None for p, h in zip(parent.tolist(), hangs.tolist())]
    columns = [
        pa.array(spine.astype(np.int32)), pa.array(least), pa.array(depth),
        pa.array(least[parent], mask=hangs | (parent < 0)), pa.array(spine_parent, pa.binary()), pa.array(n_convs),
        pa.array(n_children), pa.array(n_leaves), pa.array(saved_tokens), pa.array(digest), pa.array(key, pa.binary()),
        pa.array(np.full(count, shard)), pa.array(np.arange(count)), pa.array(branch.astype(np.int32)), pa.array(n_chars), pa.array(ends)]
    names = [c.split()[0] for c in _NODES.split(",")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    paths: list[bytes] = []
    lens: list[np.ndarray] = []
    convs: list[int] = []
    size = 0
    for batch in batches:
        for path, chars, conv in zip(*(batch.column(i) for i in range(3))):
            if paths and size + len(chars) + 1 > most:
                yield shard_nodes(paths, np.concatenate(lens), np.array(convs), number)
                paths, lens, convs, size, number = [], [], [], 0, number + 1
            paths.append(path.as_py())
            lens.append(chars.values.to_numpy().astype(np.int64))
            convs.append(conv.as_py())
            size += len(chars) + 1
    if paths:
        yield shard_nodes(paths, np.concatenate(lens), np.array(convs), number)


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)), 1, KEY)


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % _HEADS


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(path, lens, conv_id): each conversation's rebuilt turns as joined 16-byte keys, and their code points.

    Turns are ordered by turn (null first), then role and text; texts travel only where two rows of
    one turn and role differ in them. Equal rows are turns of their own.
    """
    given = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ties = saved(given.groupBy("conv_id", "turn", "role").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
                 .where("a <> b").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r")), "ties")
    met = given.join(ties, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")), "left")
    small = met.select(
        (F.col("conv_id") - F.col("conv_id") % _FAMILY).alias("family"), "conv_id", "turn", "role",
        F.when(F.col("c").isNotNull(), F.col("text")).alias("tie"), turn_key(F.col("role"), F.col("text")).alias("key"),
        F.char_length("text").cast("long").alias("n"))
    order = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    turns = saved(small.repartition("family").withColumn("pos", F.row_number().over(order) - 1).select("family", "conv_id", "pos", "key", "n"), "turns")
    heads = turns.where((F.col("conv_id") == F.col("family")) & (F.col("pos") < _HEADS - 1)).groupBy("family").agg(
        F.sort_array(F.collect_list(F.struct("pos", "key", "n"))).alias("head"))
    h = head_turns(F.col("conv_id"))
    own = turns.groupBy("family", "conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos") >= h, F.struct("pos", "key", "n")))).alias("own"))
    whole = F.concat(F.slice(F.coalesce("head", F.array().cast("array<struct<pos:int,key:binary,n:bigint>>")), 1, h.cast("int")), F.col("own"))
    rows = own.join(heads, "family", "left").select("conv_id", whole.alias("turns"))
    paths = saved(rows.select(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
                              F.transform("turns", lambda t: t["n"]).alias("lens"), "conv_id"), "paths")
    dropped(ties, turns)
    return paths


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) of sorted pieces (key, first, ends); a key's pieces are hashed as they come."""
    now, digest = None, None

    def row(key, done):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([done.hexdigest()])], names=["end_key", "digest"])

    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(2)):
            if key != now:
                if now is not None:
                    yield row(now, digest)
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.as_buffer())
    if now is not None:
        yield row(now, digest)


def _merged_spine(spine: DataFrame) -> DataFrame:
    """One row per node of the shards' spines, in the columns of the result and with its key."""
    sums = saved(spine.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        F.first("n_chars").alias("n_chars"), F.min("shard").alias("owner"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))), "spine")
    children = sums.where("parent_key IS NOT NULL").groupBy("parent_key").agg(F.count("*").alias("more")).withColumnRenamed("parent_key", "key")
    nodes = saved(sums.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).select(
        "key", "conv_id", "depth", "parent_key", "owner", "n_convs", "n_children", "n_leaves", "saved_tokens",
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("own")), "spine")
    mine = nodes.select("key", F.col("owner").alias("shard"), "leaf", "own")
    along = spine.select("key", "shard", "place", "branch").join(mine, ["key", "shard"], "left")
    after = Window.partitionBy("shard").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    shard = Window.partitionBy("shard")

    def under(c: str) -> Column:     # a first path ends where the last one branches off
        other = F.sum(F.when(F.col("branch") == 2, F.col(c))).over(shard)
        return F.coalesce(F.sum(c).over(after), F.lit(0)) - F.when(F.col("branch") == 1, F.coalesce(other, F.lit(0))).otherwise(0)

    below = along.select("key", under("leaf").alias("leaf"), under("own").alias("own")).groupBy("key").agg(
        F.sum("leaf").alias("leaves_below"), F.sum("own").alias("saved_below"))
    pieces = spine.where("ends <> ''").select("key", F.split_part("ends", F.lit(","), F.lit(1)).cast("long").alias("first"), "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "end_key binary, digest string")
    up = nodes.select(F.col("key").alias("up_key"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(below, "key").join(digests, F.col("key") == F.col("end_key"), "left").join(up, F.col("parent_key") == F.col("up_key"), "left")
    merged = saved(full.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves_below")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved_below")).alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit(b""), 256)).alias("ends_sha256")), "spine")
    dropped(sums, nodes)
    return merged


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    conv_id and parent_conv_id are smallest members; n_convs, n_children and n_leaves count members,
    children and childless nodes of the subtree; saved_tokens sums (n_convs - 1) times the code
    points of the last text over the subtree; ends_sha256 hashes the ids of the members that end
    here. Null roles and texts are empty, rows without a conv_id count for nothing, equal rows are
    turns of their own, other columns are not looked at. An empty table has no nodes.

    A group of equal conversations is dealt over shards like any other rows; as a hash is made in
    order, its ids pass one task at the end as text, a shard's at a time, and are never held together.
    """
    paths = rebuilt_paths(conversations)
    trie = trie_of(paths, shard_turns)
    dropped(paths)
    return trie


def trie_of(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """:func:`prefix_trie` of written (path, lens, conv_id) rows, as :func:`rebuilt_paths` gives them."""
    turns = paths.agg(F.sum(F.size("lens") + 1)).first()[0] or 0
    dealt = paths.repartitionByRange(max(1, -(-turns // shard_turns)), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = saved(dealt.mapInArrow(lambda batches: _shards(batches, shard_turns), _NODES), "nodes")
    spine = _merged_spine(nodes.where("kind = 1"))
    done = nodes.where("kind = 0")
    up = spine.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up"))
    hanging = done.where("parent_key IS NOT NULL").drop("parent_conv_id").join(up, F.col("parent_key") == F.col("up_key")).withColumnRenamed("up", "parent_conv_id")
    return done.where("parent_key IS NULL").select(*_RESULT).unionByName(hanging.select(*_RESULT)).unionByName(spine.select(*_RESULT))
