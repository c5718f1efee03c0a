"""Load counters, admission and streams against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators import monitoring, vectors, versioning
from pagelore.streaming import live
from pagelore.streaming.live import SECOND, Admission, Limits

EPOCH = dt.datetime(2024, 3, 1)


def log_of(spark, rows):
    return spark.createDataFrame(
        [(i, k, EPOCH + dt.timedelta(microseconds=t)) for i, (k, t) in enumerate(rows)],
        "id long, conversation_id long, asked_at timestamp_ntz")


def busy(seed, n, span, keys=3):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(keys), rnd.randrange(span * 4) * SECOND // 4) for _ in range(n)]
    return rows + rows[:10]          # several messages of one moment


def test_load_counters_across_midnight(spark):
    rows = [(k, t + 86_000 * SECOND) for k, t in busy(1, 400, 900)]
    times = sorted(t for _, t in rows)
    day = 86_400 * SECOND
    for r in monitoring.load_counters(log_of(spark, rows), limit_day=50).collect():
        t = int((r["asked_at"] - EPOCH) / dt.timedelta(microseconds=1))
        today = sum(1 for x in times if x // day == t // day and x <= t) - 1
        minute = sum(1 for x in times if t - 60 * SECOND <= x <= t) - 1
        assert (r["day_count"], r["minute_count"], r["day_capped"]) == (today, minute, today >= 50)


def slow_decisions(times, limits):
    accepted, out = [], []
    for t in times:
        day = t // (86_400 * SECOND)
        if len(accepted) >= limits.session:
            out.append("session")
        elif accepted and t - accepted[-1] < limits.cooldown * SECOND:
            out.append("cooldown")
        elif sum(1 for a in accepted if a // (86_400 * SECOND) == day) >= limits.daily:
            out.append("daily")
        elif sum(1 for a in accepted if a >= t - 60 * SECOND) >= limits.minute:
            out.append("minute")
        else:
            accepted.append(t)
            out.append("accepted")
    return out


@pytest.mark.parametrize("limits", [
    Limits(), Limits(session=1000), Limits(session=1000, daily=30), Limits(cooldown=0, minute=3), Limits(session=40, daily=12)])
def test_admission_jumps_equal_the_slow_rule(limits):
    for seed in range(5):
        times = sorted(t + 86_000 * SECOND for _, t in busy(seed, 900, 3000))
        cut = len(times) // 3
        state = Admission(limits)
        codes = np.concatenate([state.decide(np.array(times[:cut])), state.decide(np.array(times[cut:]))])
        assert [live.DECISIONS[c] for c in codes] == slow_decisions(times, limits)


def test_limits_at_their_edges():
    at = lambda *s: np.array([int(x * SECOND) for x in s])
    names = lambda limits, times: [live.DECISIONS[c] for c in Admission(limits).decide(times)]
    assert names(Limits(), at(0, 4.999, 5)) == ["accepted", "cooldown", "accepted"]
    assert names(Limits(cooldown=0, minute=1), at(0, 60, 60.000001)) == ["accepted", "minute", "accepted"]
    assert names(Limits(daily=1), at(86_390, 86_399, 86_400)) == ["accepted", "daily", "accepted"]
    assert names(Limits(session=1), at(0, 100_000)) == ["accepted", "session"]


@pytest.mark.parametrize("limits", [Limits(session=6), Limits(session=50, daily=20)])
def test_admission_over_a_stored_log(spark, limits):
    rows = busy(3, 1500, 20_000)
    expected = {}
    for key in range(3):
        mine = sorted((t, i) for i, (k, t) in enumerate(rows) if k == key)
        expected.update(zip([i for _, i in mine], slow_decisions([t for t, _ in mine], limits)))
    got = {r["id"]: r["decision"] for r in live.admission_batch(log_of(spark, rows), limits).collect()}
    assert got == expected and "session" in set(got.values()) | {"session"}


def stream(spark, rows, tmp_path, files=3):
    """The rows as a stream of ``files`` micro-batches, in the order of the last column."""
    path = str(tmp_path / "in")
    ordered = rows.orderBy(rows.columns[-1]).collect()
    step = -(-len(ordered) // files)
    for at in range(0, len(ordered), step):
        spark.createDataFrame(ordered[at:at + step], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return live.read_stream(spark, path, rows.schema, files_per_batch=1), rows


def test_admission_stream_equals_batch(spark, tmp_path):
    log, rows = stream(spark, log_of(spark, [(k, t) for k, t in busy(4, 600, 5000)]), tmp_path)
    got = {(r["id"], r["decision"]) for r in live.drain_append(live.admission_stream(log)).collect()}
    assert got == {(r["id"], r["decision"]) for r in live.admission_batch(rows).collect()}


@pytest.mark.parametrize("aggregate, value", [(live.questions_per_hour, "questions"), (live.burst_windows, "messages")])
def test_counts_do_not_depend_on_the_order_of_files(spark, tmp_path, aggregate, value):
    rows = busy(5, 300, 30_000)
    random.Random(2).shuffle(rows)
    log, rows = stream(spark, log_of(spark, rows).withColumn("arrival", F.col("id")), tmp_path, files=5)
    done = live.drain_sums(log, aggregate, ["time"])
    assert set(map(tuple, done.collect())) == set(map(tuple, aggregate(rows).collect()))
    assert done.agg(F.sum(value)).first()[0] == 310 * (1 if value == "questions" else 6)


def place(tmp_path, name="run"):
    return live.Place(str(tmp_path / f"{name}-progress"), str(tmp_path / name))


def add(spark, rows, tmp_path):
    """One more file of the stream's folder, and the stream."""
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return live.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)


def test_counts_go_on_after_a_stop_and_a_compaction(spark, tmp_path):
    parts = [log_of(spark, busy(i, 40, 9_000)) for i in range(4)]
    for i, part in enumerate(parts):
        done = live.drain_sums(add(spark, part, tmp_path), live.questions_per_hour, ["time"], place(tmp_path))
        if i == 1:
            folders = live.BatchFolders(spark, str(tmp_path / "run"), done.schema)
            folders.compact("time")
            assert len(folders.live()) == 2
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert set(map(tuple, done.collect())) == set(map(tuple, live.questions_per_hour(whole).collect()))


class Stop(Exception):
    pass


@pytest.mark.parametrize("latest", [False, True])
def test_a_compaction_stopped_at_any_step_keeps_every_row(spark, tmp_path, monkeypatch, latest):
    """Every storage call of a compaction fails once; then a replay of the last batch and a whole compaction follow."""
    schema = "key long, n long"
    steps = [(s, a) for s in ("_store", "_switch", "write_text") for a in (0, 1)] + [("remove_folder", a) for a in (0, 1, 3, 5)]
    for step, after in steps[::3] if latest else steps:
        path = str(tmp_path / f"{step}{after}")
        folders = live.BatchFolders(spark, path, spark.createDataFrame([], schema).schema)
        for i in range(4):
            folders.write(spark.createDataFrame([(k, 10 ** i) for k in range(i + 1)], schema), i)
        wanted = sorted(map(tuple, (folders.latest("key") if latest else folders.total("key")).collect()))
        owner = folders if step.startswith("_") else live
        real, calls = getattr(owner, step), []

        def stopping(*args):
            calls.append(1)
            if len(calls) > after // 2:
                if after % 2:
                    real(*args)      # stopped just after it
                raise Stop
            return real(*args)

        monkeypatch.setattr(owner, step, stopping)
        with pytest.raises(Stop):
            folders.compact("key", latest=latest)
        monkeypatch.setattr(owner, step, real)
        again = live.BatchFolders(spark, path, folders.schema)
        see = lambda: sorted(map(tuple, (again.latest("key") if latest else again.total("key")).collect()))  # noqa: E731, B023
        assert see() == wanted
        again.write(spark.createDataFrame([(k, 1000) for k in range(4)], schema), 3)
        assert see() == wanted
        again.compact("key", latest=latest)
        assert see() == wanted
        assert sorted(live.file_names(spark, f"{path}/batches")) == sorted(again.live().values())


def test_admission_goes_on_after_a_stop(spark, tmp_path):
    rows = sorted(busy(4, 200, 5000), key=lambda r: r[1])
    whole = log_of(spark, rows)
    for low, high in ((0, 120), (120, len(rows))):
        done = live.drain_append(live.admission_stream(add(spark, whole.where(f"id >= {low} and id < {high}"), tmp_path)), place(tmp_path))
    assert {(r["id"], r["decision"]) for r in done.collect()} == {(r["id"], r["decision"]) for r in live.admission_batch(whole).collect()}


def test_rows_without_a_key_are_decided_too(spark, tmp_path):
    rows = log_of(spark, [(None, 0), (1, 0), (None, SECOND), (None, 9 * SECOND), (0, SECOND)])
    expected = {0: "accepted", 1: "accepted", 2: "cooldown", 3: "accepted", 4: "accepted"}
    assert {r["id"]: r["decision"] for r in live.admission_batch(rows).collect()} == expected
    assert {r["id"]: r["decision"] for r in live.admission_batch(rows, Limits(session=1000)).collect()} == expected
    log = add(spark, rows, tmp_path)
    assert {r["id"]: r["decision"] for r in live.drain_append(live.admission_stream(log)).collect()} == expected


@pytest.mark.parametrize("limits", [Limits(minute=0), Limits(session=0), Limits(daily=0)])
def test_a_limit_of_zero_accepts_nothing(spark, limits):
    got = {r["decision"] for r in live.admission_batch(log_of(spark, busy(1, 50, 900)), limits).collect()}
    assert got == {"minute" if limits.minute == 0 else "session" if limits.session == 0 else "daily"}


def test_feedback_stream_keeps_the_last_rating(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i % 20, r, EPOCH + dt.timedelta(seconds=i)) for i, r in enumerate([1, -1, 0, 1, -1] * 40)],
        "message_id long, rating int, given_at timestamp_ntz")
    feedback, rows = stream(spark, rows, tmp_path)
    live_rows = {tuple(r) for r in live.stream_feedback(feedback, place(tmp_path)).collect()}
    assert live_rows == {tuple(r) for r in monitoring.feedback_upsert(rows).collect()}
    more = rows.limit(1).withColumns({"rating": F.lit(1), "given_at": F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")})
    again = live.stream_feedback(add(spark, more, tmp_path), place(tmp_path))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in monitoring.feedback_upsert(rows.unionByName(more)).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, EPOCH)], "message_id long, rating int, given_at timestamp_ntz")
    log = live.BatchFolders(spark, str(tmp_path / "log"), rows.schema)
    write = live.feedback_writer(log)
    write(rows, 0)
    write(rows.withColumn("rating", F.lit(-1)), 1)
    write(rows.withColumn("rating", F.lit(-1)), 1)
    assert log.rows().count() == 2 and log.latest("message_id").first()["rating"] == -1


def test_only_complete_loads_are_merged(spark, tmp_path):
    """Loads of several files, one file per micro-batch, arriving mixed and over several runs."""
    cols = ["content"]
    loads = [[("a", "s", "1"), ("b", "s", "1"), ("c", "s", "1")], [("a", "s", "2"), ("b", "s", "1")], [("a", "s", "2"), ("b", "s", "1"), ("d", "s", "1")]]
    at = lambda i: F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp_ntz")
    frames = [spark.createDataFrame(rows, "url string, section string, content string") for rows in loads]
    history = versioning.first_load(frames[0], at(0), cols)
    manifest = frames[0].limit(0).withColumns({"loaded_at": at(0), "n_rows": F.lit(0).cast("long")}).select("loaded_at", "n_rows")
    for i, rows in enumerate(loads):
        manifest = manifest.unionByName(spark.range(1).select(at(i).alias("loaded_at"), F.lit(len(rows)).cast("long").alias("n_rows")))
    expected = [history]
    for i in (1, 2):
        expected.append(versioning.scd2_merge(expected[-1], frames[i], at(i), cols))

    def run(*files):
        for load, row in files:
            arriving = add(spark, frames[load].where(F.col("url") == row).withColumn("loaded_at", at(load)), tmp_path)
        return sorted(map(tuple, live.stream_scd2(arriving, manifest, history.schema, cols, place(tmp_path)).collect()), key=str)

    def same(got, i):
        assert got == sorted(map(tuple, expected[i].collect()), key=str)

    assert run((0, "a"), (1, "a"), (0, "b")) == []
    same(run((0, "c"), (2, "a"), (2, "b")), 0)
    same(run((2, "d")), 0)                     # complete, but the load before it is not
    same(run((1, "b")), 2)
    assert len(live.file_names(spark, str(tmp_path / "run" / "history" / "manifest"))) == 2


@pytest.mark.parametrize("at_once", [8, 1])
def test_loads_that_a_batch_completes_are_not_copied(spark, tmp_path, monkeypatch, at_once):
    """Loads 0 and 1 come whole, load 2 with all rows but one; its last row comes later. Each batch comes twice."""
    schema, cols = "url string, section string, content string", ["content"]
    at = lambda i: F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp_ntz")
    loads = [[("a", "s", "1"), ("b", "s", "1")], [("a", "s", "2")], [("a", "s", "2"), ("b", "s", "3")]]
    frames = [spark.createDataFrame(rows, schema).withColumn("loaded_at", at(i)) for i, rows in enumerate(loads)]
    manifest = frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("loaded_at").agg(F.count(F.lit(1)).alias("n_rows"))
    whole = versioning.first_load(frames[0].drop("loaded_at"), at(0), cols)
    for i in (1, 2):
        whole = versioning.scd2_merge(whole, frames[i].drop("loaded_at"), at(i), cols)
    copied, write = [], live.BatchFolders.write
    monkeypatch.setattr(live.BatchFolders, "write", lambda self, rows, n: copied.append((n, rows.count())) or write(self, rows, n))
    monkeypatch.setattr(live.HistoryVersions, "AT_ONCE", at_once)
    place = str(tmp_path / "history")
    versions = live.HistoryVersions(spark, place, cols, manifest, frames[0].schema)
    first = frames[0].unionByName(frames[1]).unionByName(frames[2].where("url = 'a'"))
    lost = frames[2].where("url = 'b'").unionByName(spark.createDataFrame([("z", "s", "9")], schema).withColumn("loaded_at", F.lit(None).cast("timestamp_ntz")))
    for batch, n in ((first, 0), (first, 0), (lost.where("url = 'z'"), 1), (lost.where("url = 'b'"), 2), (lost.where("url = 'b'"), 2)):
        versions = live.HistoryVersions(spark, place, cols, manifest, frames[0].schema)
        versions.arrive(batch, n)
        assert versions.history.loads() == (2 if n < 2 else 3)
    assert copied == ([(0, 1), (0, 1), (1, 1)] if at_once == 8 else [(0, 4), (0, 4), (1, 1), (2, 1), (2, 1)])
    fields = whole.columns
    assert sorted(map(str, versions.history.read().select(*fields).collect())) == sorted(map(str, whole.collect()))
    assert [r["url"] for r in versions.held.rows().collect()] == ["z"]


def test_embedding_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [("T", None, f"text {i} word", i) for i in range(30)], "page_title string, heading_path string, content string, chunk_id long")
    arriving, rows = stream(spark, rows, tmp_path)
    encoder = vectors.hashed_term_encoder(16)
    live_rows = {(r["chunk_id"], tuple(r["embedding"])) for r in live.stream_embed(arriving, encoder).collect()}
    filled = vectors.embed_missing(rows.withColumn("embedding", F.lit(None).cast("array<float>")), encoder)
    assert live_rows == {(r["chunk_id"], tuple(r["embedding"])) for r in filled.collect()}
    assert filled.where(F.size("embedding") != 16).count() == 0


def test_embedding_stream_keeps_vectors_and_goes_on(spark, tmp_path):
    columns = "page_title string, heading_path string, content string, chunk_id long, embedding array<float>"
    encoder = vectors.hashed_term_encoder(4)
    first = spark.createDataFrame([("T", None, "a", 1, [9.0, 9.0, 9.0, 9.0]), ("T", None, "b", 2, None)], columns)
    second = spark.createDataFrame([("T", None, "c", 3, None)], columns)
    for part in (first, second):
        done = live.stream_embed(add(spark, part, tmp_path), encoder, place(tmp_path))
    got = {r["chunk_id"]: list(r["embedding"]) for r in done.collect()}
    assert set(got) == {1, 2, 3} and got[1] == [9.0] * 4 and len(got[3]) == 4
