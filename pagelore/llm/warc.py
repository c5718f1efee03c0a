"""WARC archives and their fixity, by Merkle trees over records and offset ranges.

Pages become WARC records, packed in the order of their ids into archives of up to
``per_file`` records, one gzip stream each. An archive read back gives one leaf per
record: its offsets and the SHA-256 of its bytes. Leaves in order are hashed ``fan`` at a
time into nodes of growing offset ranges, up to one root per archive and one for all.
Two replicas are compared at the root, and only the children of nodes that differ are
looked at below, so an audit of equal replicas reads one row and a damaged record costs
its path.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.tables import saved

PER_FILE, FAN = 1024, 16
PLACE = ["archive", "part", "position"]
_END, _START = b"\r\n\r\n", b"WARC/1.1\r\n"
_READ = 1 << 20


def record_text(page_id: Column, url: Column, html: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """One resource record without its closing line ends; null html is an empty block."""
    block = F.coalesce(html, F.lit(""))
    uri = F.regexp_replace(url, r"[\x00-\x20]", "")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
             per_file: int = PER_FILE, stored: Column | None = None) -> DataFrame:
    """(archive, part, page_id, tie, value): the record of every page and the archive it belongs to.
    ``stored`` is what to write in place of the page, without a change of its place.

    Archives are ranges of ``per_file`` ids; null ids share archive -1. Where ids repeat, an
    archive is split by a hash of its rows into ``part``s of about ``per_file`` records, however
    large the table is.
    """
    in_archive = F.coalesce(F.floor(F.col(page_id) / per_file).cast("long"), F.lit(-1))
    rows = pages.select(
        in_archive.alias("archive"), F.col(page_id).alias("page_id"),
        F.xxhash64(F.col(url), F.col(html)).alias("tie"), record_text(F.col(page_id), F.col(url), F.col(html) if stored is None else stored).alias("value"))
    counts = pages.groupBy(in_archive.alias("archive")).count().where(F.col("count") > per_file)
    # written, so that its size is known where the join is planned: broadcast only if it is small
    crowded = saved(counts.select("archive", F.ceil(F.col("count") / per_file).cast("int").alias("parts")), "crowded")
    return rows.join(crowded, "archive", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("page_id", "tie"), "parts").cast("int"), F.lit(0))).drop("parts")


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip file per archive and part, its records ordered by id and closed by two line ends."""
    ordered = records.repartition("archive", "part").sortWithinPartitions("archive", "part", "page_id", "tie")
    ordered.select("value", "archive", "part").write.partitionBy("archive", "part").option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").text(path)


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of any number of members (or of a plain file), as far as it is readable."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    try:
        while data:
            member = zlib.decompressobj(31)
            rest = data
            while rest and not member.eof:
                yield member.decompress(rest, _READ)
                rest = member.unconsumed_tail
            yield member.flush()
            data = member.unused_data
    except zlib.error:
        return


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record. A header that cannot be read ends where the next begins."""
    buffer, at, open_ = b"", 0, True

    def more(size: int) -> bool:
        nonlocal buffer, open_
        parts, have = [buffer], len(buffer)
        while have < size and open_:
            part = next(stream, None)
            open_ = part is not None
            if part:
                parts.append(part)
                have += len(part)
        buffer = b"".join(parts)
        return have >= size

    while more(1):
        head = buffer.find(_END)
        while head < 0 and more(len(buffer) + 1):
            head = buffer.find(_END)
        lengths = [x for x in buffer[:max(head, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        number = lengths[0].split(b":", 1)[1].strip() if lengths else b""
        end = head + 4 + int(number) + 4 if head >= 0 and buffer.startswith(_START) and number.isdigit() else -1
        if end < 0 or not more(end) or buffer[end - 4:end] != _END or (more(end + 1) and not buffer[end:end + 10].startswith(_START[:len(buffer) - end])):
            found = buffer.find(_END + _START, 1)
            while found < 0 and more(len(buffer) + 1):
                found = buffer.find(_END + _START, 1)
            end = found + 4 if found >= 0 else len(buffer)
        yield at, buffer[:end]
        at, buffer = at + end, buffer[end:]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, part, ordinal, start, stop, record_id, sha256): the leaves of every archive under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                starts, stops, names, hashes = [], [], [], []
                for at, record in split_records(inflated(data)):
                    line = record.find(b"WARC-Record-ID: ", 0, 4096)
                    starts.append(at)
                    stops.append(at + len(record))
                    names.append(record[line + 16:record.find(b"\r\n", line)].decode("utf-8", "replace") if line >= 0 else None)
                    hashes.append(hashlib.sha256(record).hexdigest())
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(names, pa.string()), pa.array(hashes, pa.string())],
                    names=["archive", "part", "ordinal", "start", "stop", "record_id", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    place = [F.regexp_extract("path", rf"/{k}=(-?\d+)/", 1).cast(t).alias(k) for k, t in (("archive", "long"), ("part", "int"))]
    return files.select(*place, "content").mapInArrow(
        run, "archive long, part int, ordinal long, start long, stop long, record_id string, sha256 string")


def _grown(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], list[list[Column]]]:
    """The levels of the trees of both replicas, leaves first, and how a node's place
    (archive, part, position) gives its parent's. Trees grow over the records of a part,
    then over the parts of an archive, then over archives, to one root per replica."""
    levels = [saved(leaves, "leaves")]
    most = levels[0].agg(F.max("position").alias("position"), F.max("part").alias("part"),
                         F.min("archive").alias("low"), F.max("archive").alias("high")).first()
    positions, parts, low, high = (most[k] or 0 for k in ("position", "part", "low", "high"))
    zero = F.lit(0).cast("long")
    steps: list[list[Column]] = []
    while positions or parts or low != high:
        if positions:
            positions //= fan
            step = [F.col("archive"), F.col("part"), F.floor(F.col("position") / fan)]
        elif parts:
            parts //= fan
            step = [F.col("archive"), F.floor(F.col("part") / fan).cast("int"), zero]
        elif high - low > 1:
            low, high = low // fan, high // fan
            step = [F.floor(F.col("archive") / fan), F.lit(0), zero]
        else:
            low = high = 0
            step = [zero, F.lit(0), zero]
        steps.append(step)
        child = F.struct(*PLACE, "sha256")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat_ws(
            ":", *(x[c].cast("string") for c in PLACE), x["sha256"])), "\n")
        parents = levels[-1].groupBy("replica", *(c.alias(n) for c, n in zip(step, PLACE))).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(joined.cast("binary"), 256).alias("sha256"))
        levels.append(saved(parents, "nodes"))
    return levels, steps


def audit(first: DataFrame, second: DataFrame, fan: int = FAN) -> DataFrame:
    """(archive, part, position, start, stop, first_sha256, second_sha256) of every record that
    differs between two replicas' leaves, or that one of them lacks (null there).

    Roots are compared first; a level below, only children of differing nodes are read. The
    offset range is the first replica's, or the second's where the first lacks the record.
    """
    both = [x.select(F.lit(i).alias("replica"), "archive", "part", F.col("ordinal").alias("position"), "start", "stop", "sha256")
            for i, x in enumerate((first, second))]
    levels, steps = _grown(both[0].unionByName(both[1]), fan)

    def of(replica: int, column: str) -> Column:
        return F.max(F.when(F.col("replica") == replica, F.col(column)))

    def differing(nodes: DataFrame) -> DataFrame:
        seen = nodes.groupBy(*PLACE).agg(
            *(F.coalesce(of(0, c), of(1, c)).alias(c) for c in ("start", "stop")),
            of(0, "sha256").alias("first_sha256"), of(1, "sha256").alias("second_sha256"))
        return seen.where(~F.col("first_sha256").eqNullSafe(F.col("second_sha256")))

    found = differing(levels[-1])
    for nodes, step in zip(reversed(levels[:-1]), reversed(steps)):
        above = [f"above_{n}" for n in PLACE]
        parents = found.select(*(F.col(n).alias(a) for n, a in zip(PLACE, above)))
        children = nodes.withColumns({a: c for a, c in zip(above, step)}).join(parents, above, "left_semi")
        found = differing(children)
    return found


def fixity_check(pages: DataFrame, folder: str, damage: Column | None = None, per_file: int = PER_FILE) -> DataFrame:
    """Writes ``pages`` as two replicas under ``folder``, reads both back and audits them.

    One row per record of the first replica: (archive, part, position, start, stop,
    record_id, sha256, intact). Where ``damage`` is true, the first character of the page is
    overwritten in the second replica, to show what an audit finds. Pages may be null, empty
    or repeated; a table without rows gives none.
    """
    spark = pages.sparkSession
    spoilt = F.when(F.coalesce(damage if damage is not None else F.lit(False), F.lit(False)) & (F.length("html") > 0),
                    F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    for name, html in (("first", F.col("html")), ("second", spoilt)):
        write_warc(archived(pages, per_file=per_file, stored=html), f"{folder}/{name}")
    first, second = (read_warc(spark, f"{folder}/{name}") for name in ("first", "second"))
    first = saved(first, "leaves")
    bad = audit(first, second).select("archive", "part", F.col("position").alias("ordinal"), F.lit(False).alias("intact"))
    return first.join(bad, ["archive", "part", "ordinal"], "left").withColumn("intact", F.coalesce("intact", F.lit(True)))
