"""Tables the engine keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.operators.ranking import row_ids
from pagelore.schemas import EXPERIMENTS, MESSAGE_WRITE_COLUMNS


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a table's schema; columns the load lacks become NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def replace_load(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Replace a table wholesale (S4). A nullable column exists even when no row
    of this load fills it."""
    conform(df, schema).write.mode("overwrite").parquet(path)


def write_history(history: DataFrame, path: str) -> None:
    """Page history with the open versions apart, so current reads skip the rest."""
    history.withColumn("is_current", F.col("valid_to").isNull()).write.partitionBy(
        "is_current").mode("overwrite").parquet(path)


def read_current(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("is_current").cast("boolean")).drop("is_current")


def experiment_rows(scores: DataFrame, config: list[str], name: Column, notes: str,
                    extra: list[str] | None = None) -> DataFrame:
    """Metric rows in the experiment schema, without id and time."""
    packed = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
    return conform(scores.select(
        "*", name.alias("name"), F.to_json(F.struct(*config)).alias("config"),
        F.lit(notes).alias("notes"), packed.alias("extra")), EXPERIMENTS)


def append_experiments(rows: DataFrame, path: str, last_id: int = 0) -> None:
    """Append metric rows with consecutive ids and the time of the write."""
    own = [c for c in EXPERIMENTS.fieldNames() if c not in ("id", "ran_at")]
    numbered = row_ids(rows.select(*own), ["name", "config"], first=last_id + 1)
    conform(numbered.withColumn("ran_at", F.current_timestamp()), EXPERIMENTS).write.mode(
        "append").parquet(path)


def message_rows(exchanges: DataFrame, asked_at: Column | None = None) -> DataFrame:
    """Exchanges in the columns the log writes, with the day they belong to."""
    at = F.current_timestamp() if asked_at is None else asked_at
    own = [F.col(c) if c in exchanges.columns else F.lit(None).alias(c) for c in MESSAGE_WRITE_COLUMNS]
    return exchanges.select(*own, at.alias("asked_at"), F.to_date(at).alias("asked_on"))


def append_messages(exchanges: DataFrame, path: str, asked_at: Column | None = None) -> None:
    message_rows(exchanges, asked_at).write.partitionBy("asked_on").mode("append").parquet(path)


def first_seen_conversations(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Conversations with their first question, new ones only."""
    seen = log.groupBy(F.col("conversation_id").alias("id")).agg(F.min("asked_at").alias("started_at"))
    return seen if existing is None else seen.join(existing.select("id"), "id", "left_anti")
