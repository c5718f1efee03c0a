"""Marks rows whose key is in a set, without moving the rows.

A set too large to broadcast would be met by a shuffle of whole rows, texts included. Here such a set
is spread over bitmaps (a Bloom filter in parts of 4 KB, 2 bytes a key), and these are broadcast. Keys
outside the set that pass the bitmaps, about one in a thousand, are listed and broadcast as well, so
that the split is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.session import materialize

BROADCAST_ROWS = 50_000     # keys broadcast as they are
PART_BITS = 32_768          # of one bitmap
KEYS_A_PART = PART_BITS // 16
PARTS = 16_384              # 64 MB of bitmaps at most; with more keys than fit, more pass and are listed
HASHES = 6


def _hash(i: int, key: Sequence[str], n: int) -> Column:
    """Below ``n``; equal for values that are equal as texts, whatever their types."""
    return F.pmod(F.xxhash64(F.lit(i), *[F.col(k).cast("string") for k in key]), F.lit(n)).cast("int")


def _part(key: Sequence[str], parts: int) -> Column:
    return _hash(0, key, parts)


def _places(key: Sequence[str]) -> list[Column]:
    """The bits of a key within its part."""
    return [_hash(i, key, PART_BITS) for i in range(1, HASHES + 1)]


def _bitmaps(chosen: DataFrame, key: Sequence[str], parts: int) -> DataFrame:
    bits = chosen.select(_part(key, parts).alias("__part"), F.explode(F.array(*_places(key))).alias("at"))
    return materialize(bits.repartition("__part").groupBy("__part").agg(
        F.bitmap_construct_agg(F.col("at").cast("long")).alias("__bits")), "sieve")


def _passes(rows: DataFrame, maps: DataFrame, key: Sequence[str], parts: int) -> DataFrame:
    """``rows`` with ``__maybe``: true for every key of the set and few others, never null."""
    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return F.getbit(byte.cast("int"), at % 8) == 1

    maybe = F.col("__bits").isNotNull()
    for at in _places(key):
        maybe = maybe & is_set(at)
    return rows.withColumn("__part", _part(key, parts)).join(F.broadcast(maps), "__part", "left").select(
        *rows.columns, F.coalesce(maybe, F.lit(False)).alias("__maybe"))


def mark(rows: DataFrame, chosen: DataFrame, count: int, known: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether their ``key`` is among the ``count`` rows of ``chosen``.

    ``known`` has the key of every row that is not chosen, and may have more. A key with a null is never chosen."""
    key, found = list(key), F.col("__found").isNotNull()
    if count <= BROADCAST_ROWS:
        few = chosen.select(*key).distinct().withColumn("__found", F.lit(True))
        return rows.join(F.broadcast(few), key, "left").select(*rows.columns, found.alias(name))
    parts = min(ceil(count / KEYS_A_PART), PARTS)
    maps = _bitmaps(chosen.dropna(subset=key), key, parts)
    wrong = materialize(_passes(known.select(*key), maps, key, parts).where("__maybe").select(*key).join(
        chosen, key, "left_anti").dropna().distinct().withColumn("__found", F.lit(True)), "wrong")
    if wrong.count() <= BROADCAST_ROWS:
        wrong = F.broadcast(wrong)
    inside = F.col("__maybe") & ~found
    for k in key:
        inside = inside & F.col(k).isNotNull()
    return _passes(rows, maps, key, parts).join(wrong, key, "left").select(*rows.columns, inside.alias(name))


def split(rows: DataFrame, chosen: DataFrame, count: int, known: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that :func:`mark` marks, and the others."""
    marked = mark(rows, chosen, count, known, key, "__inside")
    return marked.where("__inside").drop("__inside"), marked.where("NOT __inside").drop("__inside")
