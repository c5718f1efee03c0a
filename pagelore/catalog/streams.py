"""Registered queries: streams run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.catalog import views as v
from pagelore.catalog.registry import Tables, query
from pagelore.operators import vectors
from pagelore.session import new_path, remove_folder
from pagelore.sources.history import PACKED
from pagelore.streaming import live


def stream_of(t: Tables, table: str) -> DataFrame:
    # A pattern takes a table kept as one file as well as one kept as a folder.
    return live.read_stream(t.spark, f"{t.root}/{table}.parque?", getattr(t, table).schema)


def message_stream(t: Tables) -> DataFrame:
    return stream_of(t, "events").selectExpr(*v.MESSAGE_COLUMNS)


def _ntz(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("t1_stream_questions_per_hour", v.with_views("messages_v", body="""
SELECT CAST(date_trunc('hour', asked_at) AS TIMESTAMP) AS time, CAST(count(*) AS BIGINT) AS questions
FROM messages_v GROUP BY 1"""))
def t1(t: Tables):
    return _ntz(live.drain_sums(message_stream(t), live.questions_per_hour, ["time"]))


@query("t2_stream_burst", v.with_views("messages_v", body="""
SELECT CAST(time_bucket(INTERVAL 10 SECOND, asked_at) - INTERVAL 10 SECOND * back AS TIMESTAMP) AS time,
  CAST(count(*) AS BIGINT) AS messages FROM messages_v, range(6) r(back) GROUP BY 1"""))
def t2(t: Tables):
    return _ntz(live.drain_sums(message_stream(t), live.burst_windows, ["time"]))


# Follows each conversation's messages one by one, with the times accepted so far.
ADMISSION_SQL = v.with_views("messages_v", body="").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """
, asked AS (SELECT conversation_id AS key, id, epoch_us(asked_at) AS micros,
    row_number() OVER (PARTITION BY conversation_id ORDER BY asked_at, id) AS n FROM messages_v),
steps AS (
  SELECT DISTINCT key, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS micros, CAST(0 AS BIGINT) AS n,
    CAST(NULL AS VARCHAR) AS decision, CAST([] AS BIGINT[]) AS taken FROM asked
  UNION ALL
  SELECT key, id, micros, n, decision, CASE WHEN decision = 'accepted' THEN list_append(taken, micros) ELSE taken END
  FROM (SELECT a.key, a.id, a.micros, a.n, s.taken, CASE
      WHEN len(s.taken) >= 25 THEN 'session'
      WHEN len(s.taken) > 0 AND a.micros - s.taken[-1] < 5000000 THEN 'cooldown'
      WHEN len(list_filter(s.taken, lambda x: x // 86400000000 = a.micros // 86400000000)) >= 200 THEN 'daily'
      WHEN len(list_filter(s.taken, lambda x: x >= a.micros - 60000000)) >= 10 THEN 'minute'
      ELSE 'accepted' END AS decision
    FROM steps s JOIN asked a ON a.key = s.key AND a.n = s.n + 1))
SELECT key, id, micros AS "at", decision FROM steps WHERE n > 0"""


@query("t3_admission_control", ADMISSION_SQL)
def t3(t: Tables):
    return live.drain_append(live.admission_stream(message_stream(t)))


@query("t3_admission_batch", ADMISSION_SQL)
def t3_batch(t: Tables):
    return live.admission_batch(v.messages(t))


@query("t4_stream_feedback", v.with_views("rated_v", body="SELECT message_id, rating, given_at FROM rated_v"))
def t4(t: Tables):
    arriving = stream_of(t, "events").where("event_type <> 'error'").selectExpr(*v.FEEDBACK_COLUMNS)
    return live.stream_feedback(arriving)


@query("t5_stream_scd2", v.with_views("history_3", body="""
SELECT url, section, title, row_hash, valid_from, valid_to FROM history_3"""))
def t5(t: Tables):
    path = new_path(t.spark, "loads")
    for at, load in zip(v.LOADS, (v.load_1, v.load_2, v.load_3)):
        load(t).withColumn("loaded_at", v.moment(at)).write.mode("append").options(**PACKED).parquet(path)
    schema = t.spark.read.parquet(path).schema
    first = v.stored_history(t, 1)
    history = first.read().schema
    remove_folder(t.spark, first.path)
    manifest = t.spark.read.schema(schema).parquet(path).groupBy("loaded_at").agg(F.count(F.lit(1)).alias("n_rows"))
    merged = live.stream_scd2(live.read_stream(t.spark, path, schema), manifest, history, v.PAGE_COLS)
    return merged.select("url", "section", "title", "row_hash", "valid_from", "valid_to")


@query("t6_stream_embed", """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(source || chr(10) || text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
dims AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % 64 AS dim, count(*) AS n FROM words GROUP BY 1, 2)
SELECT doc_id, CAST(count(*) AS INT) AS n_used, round(CAST(CAST(max(n) / sqrt(sum(CAST(n AS DOUBLE) * n)) AS FLOAT) AS DOUBLE), 5) AS largest
FROM dims GROUP BY doc_id""")
def t6(t: Tables):
    arriving = stream_of(t, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_title"), F.lit(None).cast("string").alias("heading_path"),
        F.col("text").alias("content"))
    done = live.stream_embed(arriving, vectors.hashed_term_encoder(64))
    return done.select(
        F.col("chunk_id").alias("doc_id"), F.size(F.filter("embedding", lambda x: x != 0)).alias("n_used"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("largest"))
