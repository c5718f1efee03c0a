"""Consecutive row numbers without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.session import materialize


def row_ids(df: DataFrame, order: Sequence[str], name: str = "id", first: int = 1) -> DataFrame:
    """Number rows ``first, first+1, …`` in the order of ``order`` (a unique key).

    Rows are range-partitioned and written once with their range number, numbered
    within each range, and shifted by the size of the earlier ranges. The written
    table fixes the ranges, so a recomputed task cannot move a boundary.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(
        "__range", F.spark_partition_id())
    stored = materialize(ranged, "ranged")
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order)).cast("long")
    # One row per range; a window over them is a driver-sized table.
    sizes = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(
        F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("before"))
    numbered = stored.withColumn("within", within).join(F.broadcast(offsets), "__range")
    return numbered.select(
        (F.col("within") + F.col("before") + F.lit(first - 1)).cast("long").alias(name), *df.columns)
