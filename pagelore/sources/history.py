"""Page history on storage, of which a merge writes what has changed (V3, V4, T5).

Closed versions never change: those that a load closes are written once, into a folder of
their own whose interval (earliest start, common end) stands in the manifest. Open versions
lie in buckets by key; a load writes anew the buckets in which something changed. The newest
manifest names the folders that count, and each merge ends with one rename that makes the
next manifest visible, so a stop at any step leaves the history before or after the load.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.operators import sieve, versioning
from pagelore.session import file_names, materialize, read_text, remove_folder, write_text

NTZ = "timestamp_ntz"
#: How page texts are written: in three fifths of what Spark's default takes on disk.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def _moment(at: datetime | str) -> str:
    return at if isinstance(at, str) else at.replace(tzinfo=None).isoformat(" ", "microseconds")


@dataclass
class _Manifest:
    loads: int = 0
    last: str = ""
    schema: str = ""
    open: dict[str, str] = field(default_factory=dict)         # bucket -> folder
    closed: list[list] = field(default_factory=list)           # [folder, first start, end]


class StoredHistory:
    """Versions of pages under ``path``, with ``row_hash``, ``valid_from`` and ``valid_to``."""

    KEPT = 2    # manifests whose folders stay for readers

    def __init__(self, spark: SparkSession, path: str, cols: Sequence[str], key: str = "url", buckets: int = 64):
        self.spark, self.path, self.cols, self.key, self.buckets = spark, path, list(cols), key, buckets

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in file_names(self.spark, f"{self.path}/manifest") if n.isdigit())

    def _manifest(self, version: int | None = None) -> _Manifest:
        versions = self._versions()
        if not versions:
            return _Manifest()
        return _Manifest(**json.loads(read_text(self.spark, f"{self.path}/manifest/{version or versions[-1]}")))

    def loads(self) -> int:
        """How many loads are merged."""
        return self._manifest().loads

    def _bucket(self) -> Column:
        return (F.crc32(F.coalesce(F.col(self.key).cast("string"), F.lit("")).cast("binary")) % self.buckets).cast("int")

    def _read(self, manifest: _Manifest, folders: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _open(self, manifest: _Manifest, buckets: Sequence[str] | None = None) -> DataFrame:
        names = manifest.open if buckets is None else [b for b in buckets if b in manifest.open]
        return self._read(manifest, [f"{manifest.open[b]}/bucket={b}" for b in names])

    def current(self) -> DataFrame:
        """The open versions (S3); the closed ones are not looked at."""
        return self._open(self._manifest())

    def read(self) -> DataFrame:
        """Every version."""
        manifest = self._manifest()
        return self._read(manifest, [f for f, _, _ in manifest.closed]).unionByName(self._open(manifest))

    def as_of(self, at: datetime | str) -> DataFrame:
        """The corpus at ``at`` (V4): folders closed by then, or begun later, are left unread."""
        manifest, when = self._manifest(), _moment(at)
        closed = [f for f, start, end in manifest.closed if start <= when < end]
        rows = self._read(manifest, closed).unionByName(self._open(manifest))
        return versioning.as_of(rows, F.lit(when).cast(NTZ))

    def merge(self, incoming: DataFrame, at: datetime | str) -> None:
        """Merges one complete load as :func:`versioning.scd2_merge` does. Loads come in the order of time.

        The load's texts are read to hash them, and once more for the pages that are new or changed."""
        manifest, when = self._manifest(), _moment(at)
        if when <= manifest.last:
            raise ValueError(f"a load of {when} after one of {manifest.last}")
        moment = F.lit(when).cast(NTZ)
        versioned = versioning.with_row_hash(incoming, self.cols).withColumns({"valid_from": moment, "valid_to": F.lit(None).cast(NTZ)})
        fields = {f.name: f for f in (json_fields(manifest.schema) + list(versioned.schema.fields))}
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])
        manifest.schema = schema.json()
        name = f"{manifest.loads + 1}-{uuid.uuid4().hex}"
        if manifest.loads:
            self._change(manifest, incoming, versioned, moment, when, name)
        else:
            self._write_open(manifest, versioned, name, None)
        manifest.loads, manifest.last = manifest.loads + 1, when
        write_text(self.spark, f"{self.path}/manifest/{max(self._versions(), default=0) + 1}", json.dumps(manifest.__dict__))
        self.sweep()

    def _change(self, manifest: _Manifest, incoming: DataFrame, versioned: DataFrame, moment: Column, when: str, name: str) -> None:
        """Writes the versions that end and the buckets in which something changes.

        Texts stay where they are read, however many change: only keys and hashes are shuffled."""
        ident = [self.key, "row_hash"]
        before = self._open(manifest).select(*ident, "valid_from", F.lit(True).alias("was"))
        now = versioned.select(*ident, F.lit(True).alias("is"))
        kind = F.when(F.col("is").isNull(), "close").when(F.col("was").isNull(), "open")
        changes = materialize(before.join(now, ident, "full_outer").select(*ident, "valid_from", self._bucket().alias("bucket"), kind.alias("kind"))
                              .where("kind IS NOT NULL"), "changes")
        closes, opens = (F.count(F.when(F.col("kind") == k, 1)) for k in ("close", "open"))
        touched, start, closes, opens = changes.agg(   # at most buckets
            F.collect_set(F.col("bucket").cast("string")), F.min("valid_from").cast("string"), closes, opens).first()
        if not touched:
            return
        gone, opening = (changes.where(F.col("kind") == k).select(*ident) for k in ("close", "open"))
        ended, staying = sieve.split(self._open(manifest, touched), gone, closes, before, ident)
        if start is not None:
            ended.withColumn("valid_to", moment).write.options(**PACKED).parquet(f"{self.path}/closed/{name}")
            manifest.closed.append([f"closed/{name}", _full(start), when])
        if opens <= sieve.BROADCAST_ROWS:   # a page is hashed again only where its key is among those that open
            incoming = incoming.join(F.broadcast(opening.select(self.key).distinct()), self.key, "left_semi")
        fresh = sieve.split(versioning.with_row_hash(incoming, self.cols), opening, opens, before, ident)[0].withColumns(
            {"valid_from": moment, "valid_to": F.lit(None).cast(NTZ)})
        self._write_open(manifest, versioning.evolve_union(staying, fresh), name, touched)

    def _write_open(self, manifest: _Manifest, rows: DataFrame, name: str, touched: list[str] | None) -> None:
        """Open versions of the buckets ``touched`` (None: all) take the place of those there.

        Every task writes into the buckets of its rows. Texts brought together by bucket would cross the
        network once more, and a few buckets of any size would be sorted, each in one task."""
        columns = T.StructType.fromJson(json.loads(manifest.schema)).fieldNames()
        rows.select(*columns, self._bucket().alias("bucket")).write.partitionBy("bucket").options(
            **PACKED).parquet(f"{self.path}/open/{name}")
        written = {n.partition("=")[2] for n in file_names(self.spark, f"{self.path}/open/{name}") if n.startswith("bucket=")}
        kept = {b: f for b, f in manifest.open.items() if touched is not None and b not in touched}
        manifest.open = kept | {b: f"open/{name}" for b in written}

    def sweep(self) -> None:
        """Removes folders and manifests that none of the last ``KEPT`` manifests names."""
        versions = self._versions()
        known = [self._manifest(n) for n in versions[-self.KEPT:]]
        live = {f for m in known for f in m.open.values()} | {f for m in known for f, _, _ in m.closed}
        for kind in ("open", "closed"):
            for name in file_names(self.spark, f"{self.path}/{kind}"):
                if f"{kind}/{name}" not in live:
                    remove_folder(self.spark, f"{self.path}/{kind}/{name}")
        for old in versions[:-self.KEPT]:
            remove_folder(self.spark, f"{self.path}/manifest/{old}")


def _full(moment: str) -> str:
    """A timestamp's text with all six digits, so that texts compare as times do."""
    return _moment(datetime.fromisoformat(moment))


def json_fields(schema: str) -> list[T.StructField]:
    return list(T.StructType.fromJson(json.loads(schema)).fields) if schema else []
