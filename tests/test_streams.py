"""Streams: the chunk source, carried state, session ends, keyed sinks, late rows."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framewise.session import scratch_path
from framewise.streaming import streams as T
from framewise.streaming.feed import Feed, by_batch, replay, written_batches

START = datetime(2024, 1, 1)
EVENTS = "user_id long, event_id long, ts timestamp, event_type string, value double"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_chunks_have_many_partitions(spark, monkeypatch):
    monkeypatch.setattr("framewise.streaming.feed.FILE_ROWS", 100)
    df = spark.range(0, 2000, 1, 4).withColumn("x", F.col("id") * 2)
    feed = Feed(df, F.floor(F.col("id") / 1000))
    assert feed.chunks == 2
    sizes = replay(lambda s: s.groupBy(F.spark_partition_id().alias("p")).count(), feed, mode="update").groupBy("batch").agg(F.count("*").alias("parts"), F.sum("count").alias("rows")).collect()
    assert feed.arrived == 2 and len(sizes) == 2
    feed = Feed(df, F.floor(F.col("id") / 1000))
    seen = []
    replay(lambda s: s, feed, progress=seen)
    assert [p["numInputRows"] for p in seen if p["numInputRows"]] == [1000, 1000]
    reader = feed.stream  # every file is a partition of at most FILE_ROWS rows
    from framewise.streaming.feed import ChunkReader

    parts = ChunkReader(feed.path, reader().schema).partitions({"chunks": 0}, {"chunks": 1})
    rows = [sum(b.num_rows for b in ChunkReader(feed.path, reader().schema).read(p)) for p in parts]
    assert len(parts) >= 10 and max(rows) <= 100 and sum(rows) == 1000


def test_stream_goes_on_after_a_restart(spark):
    feed = Feed(spark.range(50).withColumn("k", F.col("id") % 5), F.floor(F.col("id") / 10))
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    start = lambda: feed.stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    query = start()
    for _ in range(2):
        feed.arrive()
        query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(out).count() == 20
    feed.arrive()
    feed.arrive()  # these come while nothing runs
    query = start()
    query.processAllAvailable()
    feed.arrive()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(50))


def test_idle_sessions_expire(spark):
    """A session's partial frame is gone once nothing came for the time to live, also in a query that starts again."""
    feed = Feed(spark.createDataFrame([(1, 0, 1000), (1, 1, 1000)], "session long, seq long, samples long"), F.col("seq"))
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for _ in range(2):
        feed.arrive()
        query = T.assemble_frames(feed.stream(), ttl="1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        ended = query.awaitTermination(60)
        query.stop()
        assert ended
        time.sleep(2)
    assert [r["held"] for r in spark.read.parquet(out).collect()] == [1000, 1000]


def test_frames_wait_over_many_chunks(spark):
    """Frame 3 comes last: all others wait for it, in the order they have, and steps that can't release any are only appended."""
    codes = lambda t, tail: [100 + t] + [tail] * 7 + [200 + t] + [tail] * 7
    steps = [(1, t, codes(t, 1000 + t - 2 if t >= 2 else T.X.PLACEHOLDER), t if t != 3 else 60) for t in range(50)] + [(1, 50, [2048] + [1048] * 7 + [2048] + [1048] * 7, 50), (1, 51, [2048] + [1049] * 7 + [2048] + [1049] * 7, 51)]
    df = spark.createDataFrame(steps, "conv_id long, frame_idx long, codes array<long>, chunk long")
    got = replay(lambda s: T.release_frames(s.drop("chunk"), 2), Feed(df, F.floor(F.col("chunk") / 4))).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in got] == list(range(50)) and [r["emitted"] for r in got] == list(range(1, 51))
    assert all(r["codes"] == [100 + t] + [1000 + t] * 7 + [200 + t] + [1000 + t] * 7 for t, r in enumerate(got))


def test_a_micro_batch_takes_many_chunks(spark):
    """As many micro-batches as loads, however long a conversation is; each chunk goes on from what the one before has left."""
    codes = lambda t: [100 + t] + [1000 + t - 2 if t >= 2 else T.X.PLACEHOLDER] * 7 + [200 + t] + [1000 + t - 2 if t >= 2 else T.X.PLACEHOLDER] * 7
    steps = [(c, t, codes(t) if (c, t) != (2, 31) else [T.X.PLACEHOLDER] * 16) for c in (1, 2) for t in range(60)]
    df = spark.createDataFrame(steps, "conv_id long, frame_idx long, codes array<long>").repartition(3)
    for n in (1, 7):
        seen = []
        feed = Feed(*T.in_loads(df, F.floor(F.col("frame_idx") / n)))
        assert feed.chunks <= T.LOADS
        got = replay(lambda s: T.release_frames(s, 2, chunk="chunk"), feed, progress=seen).orderBy("conv_id", "frame_idx").collect()
        assert [(r["conv_id"], r["frame_idx"]) for r in got] == [(1, t) for t in range(58)] + [(2, t) for t in range(29)]
        assert all(r["emitted"] == t + 1 and r["codes"] == [100 + t] + [1000 + t] * 7 + [200 + t] + [1000 + t] * 7 for r in got for t in [r["frame_idx"]])
        assert sum(p["numInputRows"] for p in seen) == len(steps) and len([p for p in seen if p["numInputRows"]]) == feed.chunks


def test_chunks_of_a_micro_batch_are_dealt_with_one_by_one(monkeypatch):
    """The processor alone, with a store in memory: in one micro-batch or in many, chunks are assembled alike."""
    import numpy as np
    import pandas as pd

    class Held(list):
        get, put, clear, appendList = (lambda s: iter(list(s))), (lambda s, x: s.__setitem__(slice(None), x)), (lambda s: s.__setitem__(slice(None), [])), list.extend

    class Value:
        x = None
        get, update = (lambda s: s.x), (lambda s, x: setattr(s, "x", x))

    def run(batches):
        step, calls = T.FrameReleaser(2, 2, None), []
        step.emitted, step.held = Value(), Held()
        monkeypatch.setattr(T, "assembled", lambda at, codes, *a: calls.append(sorted(at.tolist())) or assembled(at, codes, *a))
        out = [f for b in batches for f in step.handleInputRows((1,), iter([b]), None)]
        return calls, [tuple(r) for f in out for r in f["codes"]], step.emitted.get() or (0,), sorted(step.held)

    assembled = T.assembled
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"frame_idx": range(40), "codes": [[5 + t, T.X.PLACEHOLDER if t < 2 else 7 + t] * 2 for t in range(40)], "chunk": rng.permutation(np.arange(40) // 3)})
    many = [g for _, g in rows.groupby("chunk")]
    assert run([rows]) == run(many) and len(run(many)[1]) == 38


def session_rows(spark):
    rows = [(1, 0, "say"), (1, 10, "say"), (1, 12, "bye"), (1, 13, "say"), (1, 400, "say"), (2, 5, "bye"), (2, 5, "say"), (2, 500, "bye"), (2, 500, "bye")]
    return spark.createDataFrame([(u, i, at(m), t, 1.0) for i, (u, m, t) in enumerate(rows)], EVENTS)


def test_session_ends_at_once(spark):
    df = session_rows(spark)
    want = T.sessions(df, "1 hour", "bye")
    us = lambda m: int(at(m).timestamp() * 1_000_000)
    got = sorted(map(tuple, want.collect()))
    assert [(u, n) for u, *_, n in got] == [(1, 3), (1, 1), (1, 1), (2, 1), (2, 1), (2, 1), (2, 1)]
    assert [e - s for _, s, e, _ in got][:3] == [us(12) - us(0), 3_600_000_000, 3_600_000_000]
    for n in (1, 3, 9):
        feed = Feed(*T.flushed(df, F.floor((F.unix_micros("ts") - us(0)) / 60_000_000 * n / 501), user_id=-1))  # in time: what comes after the watermark is dropped
        assert sorted(map(tuple, replay(lambda s: T.sessions(s, "1 hour", "bye"), feed).collect())) == got
    assert T.sessions(df, "1 hour").count() == 4


def test_ended_session_comes_out_before_its_gap_is_over(spark):
    rows = [(1, 0, "say"), (1, 1, "bye"), (3, 90, "say")]
    df = spark.createDataFrame([(u, i, at(m), t, 1.0) for i, (u, m, t) in enumerate(rows)], EVENTS)
    got = replay(lambda s: T.sessions(s, "10 hours", "bye"), Feed(df, F.col("event_id"))).collect()
    assert [(r["user_id"], r["n"]) for r in got] == [(1, 2)]


def test_ends_share_timers(spark):
    """A call of a processor costs milliseconds, so neither every end nor every user has a timer of its own."""
    rows = [(None if i % 50 == 7 else i % 30 - 5, i, at(i % 50 + i // 200), "bye" if i % 3 else "say", 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, EVENTS)
    want = sorted(map(tuple, T.sessions(df, "10 minutes", "bye").collect()), key=str)
    for options, most in (({}, 30), ({"buckets": 4}, 5)):
        seen = []
        feed = Feed(*T.flushed(df, F.floor(F.col("event_id") / 200), user_id=99))
        got = replay(lambda s: T.sessions(s, "10 minutes", "bye", **options), feed, progress=seen)
        assert sorted(map(tuple, got.collect()), key=str) == want
        timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in seen]
        assert 0 < max(timers) <= 2 * most


def test_both_sides_come_out(spark):
    own = spark.createDataFrame([(1, 1, at(0), "a", 0.0), (1, 2, at(100), "a", 0.0)], EVENTS)
    user = spark.createDataFrame([(1, 3, at(1), "b", 0.0), (1, 4, at(50), "b", 0.0)], EVENTS)
    feeds = [Feed(*T.flushed(df, F.col("event_id"), user_id=-1)) for df in (own, user)]
    want = [(1, 3, "WORD", "WORD"), (2, None, "WORD", "PAD"), (None, 4, "PAD", "WORD")]
    got = replay(lambda a, b: T.sync_streams(a, b), *feeds).where("a_id IS NOT NULL OR b_id IS NOT NULL")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, T.sync_streams(own, user).collect()), key=str) == want


def test_a_batch_run_again_changes_nothing(spark):
    path = scratch_path(spark, "sink")
    write = by_batch(path)
    one, two = spark.createDataFrame([(1,), (2,)], "x long"), spark.createDataFrame([(3,)], "x long")
    write(one, 0)
    write(two, 1)
    write(one, 0)
    write(two, 1)
    assert sorted(map(tuple, written_batches(spark, path, one.schema).collect())) == [(1, 0), (2, 0), (3, 1)]
    assert written_batches(spark, scratch_path(spark, "none"), one.schema).collect() == []


@pytest.mark.parametrize("tasks", [["asr"], ["asr", "tts", "text task"]])
def test_loss_scale_takes_any_tasks(spark, tasks):
    df = spark.createDataFrame([(1, i, at(i), t, float(v)) for i, (t, v) in enumerate([("asr", 1), ("tts", 3), ("tts", 5), ("text task", 2), ("other", 100)])], EVENTS)
    r = T.loss_scale_monitor(df, tasks).first()
    assert r["asr"] == 1.0 and r["ratio"] == (4.0 if len(tasks) > 1 else 1.0) and r["alarm"] == (len(tasks) > 1)


def test_reported_late_rows_are_those_dropped(spark):
    rows = [(1, i, at(60 * 24 * d), "x", 0.0) for i, d in enumerate([0, 1, 9, 10, 0, 0, 9, 20])]
    df = spark.createDataFrame(rows, EVENTS)
    chunk = F.floor(F.col("event_id") / 2)
    by_window, by_batch_ = T.late_rows(df, chunk, "1 day", "1 day")
    assert by_window.agg(F.sum("dropped")).first()[0] == by_batch_.agg(F.sum("dropped")).first()[0] == 2
    assert {r["batch"]: r["dropped"] for r in by_batch_.collect() if r["dropped"]} == {2: 2}


def test_typed_state_where_the_session_names_another_store(spark):
    key, mode = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, mode)
    try:
        rows = spark.createDataFrame([(1, 0, 3), (1, 1, 2)], "session long, seq long, samples long")
        got = replay(lambda s: T.assemble_frames(s, 4), Feed(rows, F.col("seq"))).collect()
        assert sorted((r["first_frame"], r["n_frames"], r["held"]) for r in got) == [(0, 0, 3), (0, 1, 1)]
        got = T.run_to_table(T.assemble_frames(every_chunk(rows), 4)).collect()
        assert sum(r["n_frames"] for r in got) == 1
        assert spark.conf.get(key) == mode
    finally:
        spark.conf.set(key, before)


def every_chunk(rows):
    feed = Feed(rows, F.col("seq"))
    while feed.arrive():
        pass
    return feed.stream()


def test_held_samples_after_a_batch_without_a_whole_frame(spark):
    for rows in ([(7, 1, 0, 192), (7, 0, 1, 92)], [(7, 0, 1, 92), (7, 1, 0, 192)]):  # in whatever order batches are read
        steps = spark.createDataFrame(rows, "session long, first_frame long, n_frames long, held long").coalesce(1)
        assert [tuple(r) for r in T.frame_totals(steps).collect()] == [(7, 1, 192)]


def test_sources_and_state_need_no_package_where_spark_plans_them(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from framewise.streaming.feed import ChunkSource

    (tmp_path / "sent").write_bytes(cloudpickle.dumps([ChunkSource, T.FrameCounter, T.FrameReleaser, T.SessionCutter]))
    code = "import sys; sys.path = [p for p in sys.path if p]; from pyspark import cloudpickle; print([c.__name__ for c in cloudpickle.load(open('sent', 'rb'))], 'framewise' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={}, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and done.stdout.strip().endswith("False"), done.stderr
