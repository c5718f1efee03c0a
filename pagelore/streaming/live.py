"""Structured Streaming twins of the batch aggregates and upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelore import fixed_values as fx
from pagelore.operators import monitoring, vectors
from pagelore.session import file_names, materialize, new_path, read_text, remove_folder, write_text
from pagelore.sources.history import StoredHistory

def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


# --- Places and sinks -------------------------------------------------------

@dataclass(frozen=True)
class Place:
    """Where a stream keeps its progress and its results; a run on the same place goes on
    from the last one. Without one, a run starts afresh in the shared folder."""

    checkpoint: str
    results: str

    @staticmethod
    def of(spark: SparkSession, given: "Place | None", name: str) -> "Place":
        return given or Place(new_path(spark, f"{name}-progress"), new_path(spark, name))


class BatchFolders:
    """Results of a stream as one folder per micro-batch, named by a manifest.

    The newest file in ``manifest`` lists the folder of each batch; what it does not list is not
    there for a reader. A batch writes its folder, then a manifest that has it in place of an
    earlier try, so a replayed batch changes nothing. Every change of the results is one
    rename of a small file: a stop at any step leaves the results as they were or as they
    become, and at worst folders that nobody reads, which the next compaction removes."""

    KEPT = 5    # manifests; a reader of an older one has had its time

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self.stored = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in file_names(self.spark, f"{self.path}/manifest") if n.isdigit())

    def live(self) -> dict[int, str]:
        """Folder of every batch that counts, by batch id."""
        versions = self._versions()
        if not versions:
            return {}
        return {int(k): v for k, v in json.loads(read_text(self.spark, f"{self.path}/manifest/{versions[-1]}")).items()}

    def _switch(self, live: dict[int, str]) -> None:
        versions = self._versions()
        write_text(self.spark, f"{self.path}/manifest/{max(versions, default=0) + 1}", json.dumps(live))
        for old in versions[:-self.KEPT]:
            remove_folder(self.spark, f"{self.path}/manifest/{old}")

    def _store(self, rows: DataFrame, batch_id: int) -> str:
        name = f"{batch_id}-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames(), F.lit(batch_id).cast("long").alias("batch_id")).write.parquet(f"{self.path}/batches/{name}")
        return name

    def write(self, batch: DataFrame, batch_id: int) -> None:
        name = self._store(batch, batch_id)
        live = self.live()
        before = live.get(batch_id)
        self._switch({**live, batch_id: name})
        if before:
            remove_folder(self.spark, f"{self.path}/batches/{before}")

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/batches/{f}" for f in folders])

    def rows(self, besides: int | None = None) -> DataFrame:
        """The rows of all batches, or of all but one."""
        return self._read([name for n, name in self.live().items() if n != besides])

    def _values(self, keys: Sequence[str]) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in keys]

    def _latest(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*self._values(keys)), "batch_id").alias("v"))
        return last.select(*keys, "v.*")

    def _total(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in self._values(keys)))

    def latest(self, *keys: str) -> DataFrame:
        """The newest row of each key."""
        return self._latest(self.rows(), keys)

    def total(self, *keys: str) -> DataFrame:
        """The sum of every other column per key: for results that add up over batches."""
        return self._total(self.rows(), keys)

    def forget(self, batch_ids: Sequence[int]) -> None:
        """Leaves batches out from now on."""
        live = self.live()
        gone = [live.pop(b) for b in batch_ids if b in live]
        if gone:
            self._switch(live)
            for name in gone:
                remove_folder(self.spark, f"{self.path}/batches/{name}")

    def compact(self, *keys: str, latest: bool = False) -> None:
        """Puts what :meth:`total` (or :meth:`latest`) gives for all batches but the last in place of them.

        The last batch stays by itself, as a stream that was stopped may write it once more. The
        new folder is written, the manifest switches to it, and then the old ones go. Run it
        between runs of the stream, when nobody reads the old folders."""
        live = self.live()
        early = sorted(live)[:-1]
        if len(early) > 1:
            rows = self._read([live[b] for b in early])
            name = self._store((self._latest if latest else self._total)(rows, keys), early[-1])
            live = {early[-1]: name, max(live): live[max(live)]}
            self._switch(live)
        for name in set(file_names(self.spark, f"{self.path}/batches")) - set(live.values()):
            remove_folder(self.spark, f"{self.path}/batches/{name}")


def run_now(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drain what is available through ``foreachBatch``, then stop."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_sums(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], keys: Sequence[str],
               place: Place | None = None) -> DataFrame:
    """Aggregate each micro-batch on its own and add the results up.

    Counts do not depend on the order in which rows arrive: no state is held, no row is
    ever too late, and a backfill in any file order gives the batch result."""
    spark = stream.sparkSession
    place = Place.of(spark, place, "sums")
    folders = BatchFolders(spark, place.results, aggregate(spark.createDataFrame([], stream.schema)).schema)
    run_now(stream, lambda batch, n: folders.write(aggregate(batch), n), place.checkpoint)
    return folders.total(*keys)


def drain_append(stream: DataFrame, place: Place | None = None) -> DataFrame:
    """Run an append-only stream into a Parquet sink and read it back."""
    spark = stream.sparkSession
    place = Place.of(spark, place, "appended")
    stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", place.checkpoint
    ).trigger(availableNow=True).start(place.results).awaitTermination()
    return spark.read.schema(stream.schema).parquet(place.results)


# --- Aggregates -------------------------------------------------------------

def questions_per_hour(log: DataFrame) -> DataFrame:
    """``time, questions`` per hour that has any."""
    counts = log.groupBy(F.window(F.col("asked_at").cast("timestamp"), "1 hour")).agg(F.count(F.lit(1)).alias("questions"))
    return counts.select(F.col("window.start").alias("time"), "questions")


def burst_windows(log: DataFrame, width: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """Messages in each sliding window."""
    counts = log.groupBy(F.window(F.col("asked_at").cast("timestamp"), width, slide)).agg(
        F.count(F.lit(1)).alias("messages"))
    return counts.select(F.col("window.start").alias("time"), "messages")


# --- Admission control (T3) -------------------------------------------------

DECISIONS = ("accepted", "session", "cooldown", "daily", "minute")
SECOND = 1_000_000
DAY = 86_400 * SECOND
STATE = T.StructType([
    T.StructField("asked", T.LongType()),
    T.StructField("last", T.LongType()),
    T.StructField("day", T.LongType()),
    T.StructField("day_count", T.LongType()),
    T.StructField("recent", T.ArrayType(T.LongType())),
])


@dataclass
class Limits:
    session: int = fx.MAX_QUESTIONS_PER_SESSION
    cooldown: int = fx.QUESTION_COOLDOWN_SECONDS
    daily: int = fx.MAX_QUESTIONS_PER_DAY
    minute: int = fx.MAX_QUESTIONS_PER_MINUTE


@dataclass
class Admission:
    """What is known about one key. Only accepted questions count."""

    limits: Limits
    asked: int = 0
    last: int = -1
    day: int = -1
    day_count: int = 0
    recent: list[int] = field(default_factory=list)

    def decide(self, at: np.ndarray) -> np.ndarray:
        """Decisions for sorted times in microseconds.

        After each decision the earliest moment that can change it is known, so
        the scan jumps there: work follows accepted questions, not refused ones.
        """
        out = np.zeros(len(at), dtype=np.int8)
        i = 0
        while i < len(at):
            now = int(at[i])
            day = now // DAY
            if self.day != day:
                self.day, self.day_count = day, 0
            self.recent = [t for t in self.recent if t >= now - 60 * SECOND]
            ready = self.last + self.limits.cooldown * SECOND if self.last >= 0 else now
            if self.asked >= self.limits.session:
                reason, until = 1, len(at)
            elif now < ready:
                reason, until = 2, np.searchsorted(at, ready, "left")
            elif self.day_count >= self.limits.daily:
                reason, until = 3, np.searchsorted(at, (day + 1) * DAY, "left")
            elif self.limits.minute < 1:   # nothing is ever accepted
                reason, until = 4, len(at)
            elif len(self.recent) >= self.limits.minute:
                leaves = self.recent[-self.limits.minute] + 60 * SECOND
                reason, until = 4, np.searchsorted(at, leaves, "right")
            else:
                self.asked, self.last, self.day_count = self.asked + 1, now, self.day_count + 1
                self.recent.append(now)
                i += 1
                continue
            out[i:until] = reason
            i = int(until)
        return out


def _decided(rows: pd.DataFrame, state: Admission) -> pd.DataFrame:
    codes = state.decide(rows["at"].to_numpy())
    return rows.assign(decision=np.array(DECISIONS, dtype=object)[codes])


def _timed(log: DataFrame, key: str, order: str, at: str) -> DataFrame:
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return log.select(F.col(key).alias("key"), F.col(order).alias("id"), micros.alias("at"))


ADMISSION_OUT = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("at", T.LongType()),
    T.StructField("decision", T.StringType()),
])


def admission_stream(log: DataFrame, limits: Limits = Limits(), key: str = "conversation_id",
                     order: str = "id", at: str = "asked_at", idle: timedelta | None = None) -> DataFrame:
    """T3 live: one state per key; rows without a key share one. The decision depends on
    every earlier one of the key, so the key must be a session or tenant, and
    ``maxFilesPerTrigger`` bounds what one call sees. With ``idle``, a key that sends
    nothing for so long is forgotten and begins anew if it comes back; that is for streams
    that run on, as one waiting for such times does not end by itself."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = Admission(limits)
        if state.exists:
            asked, last, day, day_count, recent = state.get
            known = Admission(limits, asked, last, day, day_count, list(recent))
        rows = pd.concat(list(frames)).sort_values(["at", "id"], ignore_index=True)
        yield _decided(rows, known)[["key", "id", "at", "decision"]]
        state.update((known.asked, known.last, known.day, known.day_count, known.recent))
        if idle is not None:
            state.setTimeoutDuration(int(idle / timedelta(milliseconds=1)))

    return _timed(log, key, order, at).groupBy("key").applyInPandasWithState(
        step, ADMISSION_OUT, STATE, "append",
        GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def admission_batch(log: DataFrame, limits: Limits = Limits(), key: str = "conversation_id",
                    order: str = "id", at: str = "asked_at") -> DataFrame:
    """T3 over a stored log. Sorted rows flow through each task batch by batch;
    a key's rows are never gathered, its state is a few numbers.

    Among any two stretches with questions, each longer than a minute and the
    cooldown, one question is accepted. So the session cap is spent after twice
    that many stretches, and the rest of a busy key, however long, is refused
    without a sequential pass.
    """
    timed = _timed(log, key, order, at)
    if limits.session > limits.daily or limits.session < 1 or limits.minute < 1:   # something else may stop a key first
        return _admit_in_order(timed, limits)
    stretch = F.floor(F.col("at") / F.lit((max(60, limits.cooldown) + 1) * SECOND))
    timed = timed.withColumn("stretch", stretch)
    used = timed.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("key").orderBy("stretch"))
    ends = used.withColumn("place", place).where(F.col("place") <= 2 * limits.session).groupBy(
        "key").agg(F.max("stretch").alias("end"))
    ends = ends.withColumnRenamed("key", "end_key")
    rows = timed.join(ends, F.col("key").eqNullSafe(F.col("end_key")))
    early = rows.where(F.col("stretch") <= F.col("end")).select("key", "id", "at")
    late = rows.where(F.col("stretch") > F.col("end")).select(
        "key", "id", "at", F.lit(DECISIONS[1]).alias("decision"))
    return _admit_in_order(early, limits).unionByName(late)


def _admit_in_order(timed: DataFrame, limits: Limits) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Admission(limits)
        for frame in frames:
            named = frame["key"].notna()
            for group, rows in frame.groupby([named, frame["key"].where(named, 0)], sort=False):
                if group != current:
                    current, state = group, Admission(limits)
                yield _decided(rows, state)[["key", "id", "at", "decision"]]

    ordered = timed.repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, ADMISSION_OUT)


# --- Upserts and loads ------------------------------------------------------

def feedback_writer(log: BatchFolders) -> Callable[[DataFrame, int], None]:
    """T4: each micro-batch leaves its last rating per message."""
    def write(batch: DataFrame, batch_id: int) -> None:
        moment = F.struct("given_at", *(["seq"] if "seq" in batch.columns else []))
        last = batch.where(F.col("rating").isin(-1, 1)).groupBy("message_id").agg(
            F.max_by(F.struct(*batch.columns), moment).alias("r"))
        log.write(last.select("r.*"), batch_id)

    return write


def stream_feedback(feedback: DataFrame, place: Place | None = None) -> DataFrame:
    """Run T4 over what is available and read the current ratings."""
    place = Place.of(feedback.sparkSession, place, "feedback")
    log = BatchFolders(feedback.sparkSession, place.results, feedback.schema)
    run_now(feedback, feedback_writer(log), place.checkpoint)
    return monitoring.feedback_upsert(log.rows().drop("batch_id"))


class HistoryVersions:
    """T5: page history kept by :class:`StoredHistory`, of which each load changes what it must.

    ``manifest`` lists the loads (``loaded_at, n_rows``). Loads are merged in the order of the
    manifest, from the micro-batch that makes them complete and the rows held before it. Only the
    rows of a load that is not complete, or comes after one that is not, are held, in a folder per
    micro-batch: a merge of a part of it would retire the pages of the rest. A batch is read
    several times, so its rows must be the same each time, as they must be for a replay."""

    AT_ONCE = 8     # loads read from the batch itself; where there are more, a pass for each would cost more than a copy

    def __init__(self, spark: SparkSession, path: str, cols: Sequence[str], manifest: DataFrame, arriving: T.StructType):
        self.spark, self.manifest = spark, manifest
        self.history = StoredHistory(spark, f"{path}/history", cols, buckets=16)
        self.held = BatchFolders(spark, f"{path}/held", arriving)

    def arrive(self, batch: DataFrame, batch_id: int) -> None:
        others = any(n != batch_id for n in self.held.live())   # an earlier try of this batch does not count
        rows = self.held.rows(besides=batch_id).drop("batch_id").unionByName(batch) if others else batch
        seen = materialize(rows.groupBy("loaded_at").agg(F.count(F.lit(1)).alias("n")), "arrived")
        copied = seen.count() > self.AT_ONCE
        if copied:
            self.held.write(batch, batch_id)
            rows = self.held.rows().drop("batch_id")
        while self.merge_next(rows, seen):
            pass
        if not copied:
            waiting = self._waiting(batch)
            if not self._waiting(seen).isEmpty() and not waiting.isEmpty():
                self.held.write(waiting, batch_id)
        self.forget()

    def _merged(self) -> DataFrame:
        """One row, ``until``: the last load that is merged, or null."""
        return self.manifest.orderBy("loaded_at").limit(self.history.loads()).agg(F.max("loaded_at").alias("until"))

    def _waiting(self, rows: DataFrame) -> DataFrame:
        """Rows of loads that are not merged."""
        return rows.join(F.broadcast(self._merged()), F.col("loaded_at") <= F.col("until"), "left_anti")

    def forget(self) -> None:
        """Removes held batches all of whose loads are merged."""
        if not self.held.live():
            return
        over = self.held.rows().groupBy("batch_id").agg(F.max("loaded_at").alias("latest")).join(
            self._merged(), F.col("latest") <= F.col("until"))
        self.held.forget([row[0] for row in over.select("batch_id").collect()])   # the few batches of the loads just merged

    def merge_next(self, rows: DataFrame, seen: DataFrame) -> bool:
        """Merges the next load of the manifest if it is among ``rows`` in full; ``seen`` has the number of rows by load."""
        due = self.manifest.orderBy("loaded_at").offset(self.history.loads()).limit(1).first()
        if due is None:
            return False
        mine = F.col("loaded_at") == F.lit(due["loaded_at"])
        if sum(row["n"] for row in seen.where(mine).collect()) < due["n_rows"]:
            return False
        self.history.merge(rows.where(mine).drop("loaded_at"), due["loaded_at"])
        return True


def stream_scd2(loads: DataFrame, manifest: DataFrame, schema: T.StructType, cols: Sequence[str],
                place: Place | None = None) -> DataFrame:
    """Run T5 over what is available and read the history of the complete loads."""
    place = Place.of(loads.sparkSession, place, "history")
    versions = HistoryVersions(loads.sparkSession, place.results, cols, manifest, loads.schema)
    run_now(loads, versions.arrive, place.checkpoint)
    if not versions.history.loads():
        return loads.sparkSession.createDataFrame([], schema)
    return versions.history.read().select(*schema.fieldNames())


def stream_embed(chunks: DataFrame, encoder: Callable[[], vectors.Encoder], place: Place | None = None,
                 **names: str) -> DataFrame:
    """Encode arriving chunks that have no vector yet; the others pass as they are."""
    spark = chunks.sparkSession
    place = Place.of(spark, place, "embedded")
    schema = T.StructType([f for f in chunks.schema.fields if f.name != "embedding"]
                          + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    folders = BatchFolders(spark, place.results, schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        if "embedding" not in batch.columns:
            batch = batch.withColumn("embedding", F.lit(None).cast("array<float>"))
        folders.write(vectors.embed_missing(batch, encoder, **names), batch_id)

    run_now(chunks, write, place.checkpoint)
    return folders.rows().drop("batch_id")
