"""Tables written to the shared folder, to cut lineage and to feed several branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.session import new_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes what :func:`saved` wrote, when no plan will read it again."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
