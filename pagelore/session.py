"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='pagelore-')}/pagelore", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, however long its texts are, in sessions made elsewhere too."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(key, SESSION_CONF[key])


def build_session(master: str | None = None, app: str = "pagelore", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def workspace(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local-mode session may fall back to a temporary folder: on a cluster
    another executor could not read it back.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="pagelore-")
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches: the branches then scan columns
    they need, and a lost executor costs a re-read rather than a recompute.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._pagelore_stored = True
    return stored


def settle(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize`, unless ``df`` is such a table already.

    The file sizes are then known to the planner, which broadcasts the table on
    its own when it is below ``spark.sql.autoBroadcastJoinThreshold``."""
    return df if getattr(df, "_pagelore_stored", False) else materialize(df, name)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished result folders in ``path``; none where it does not exist."""
    place, files = _folder(spark, path)
    if not files.exists(place):
        return []
    return [f.getPath().getName() for f in files.listStatus(place)
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in the folder ``path``; none where it does not exist."""
    place, files = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, files = _folder(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file that is there whole or not at all: written beside its place, then renamed."""
    place, files = _folder(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(place) or not files.rename(beside, place):
        files.delete(beside, False)
        raise FileExistsError(path)


def fingerprint(df: DataFrame) -> str:
    """Changes with the files ``df`` is read from: their paths, sizes and times."""
    spark = df.sparkSession
    seen = []
    for file in sorted(df.inputFiles()):
        place, files = _folder(spark, file)
        status = files.getFileStatus(place)
        seen.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:24]


def remove_folder(spark: SparkSession, path: str) -> None:
    place, files = _folder(spark, path)
    files.delete(place, True)
