"""Structured Streaming operators. Each has a batch twin, or shares its DataFrame code with one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from framewise.functions import text as X
from framewise.session import scratch_path, written
from framewise.streaming.feed import Feed, replay, state_store

PLACEHOLDER = X.PLACEHOLDER  # state processors must not name modules of the package: see ``framewise.streaming``


def stream_chunks(spark: SparkSession, sf_dir: str, name: str = "events", per_trigger: int = 1) -> DataFrame:
    """S3: a table's files as they arrive; ``ts`` as a timestamp, as event time wants it. Chunks that are cut by a column are a ``Feed``."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path[:-1] + "[t]")  # a pattern: one file or a folder of files
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def in_chunks(column: str, df: DataFrame, n: int) -> Column:
    """``n`` chunks, 0 to n - 1, of equal ranges of a whole-number column."""
    r = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, width = r["low"] or 0, max(1, -(-((r["high"] or 0) - (r["low"] or 0) + 1) // n))
    return F.floor((F.col(column) - low) / width)


#: Micro-batches that the chunks of a feed are dealt to, and steps or events of one on average: beyond, there are more of them.
LOADS, LOAD_ROWS = 8, 1 << 22


def in_loads(df: DataFrame, chunk: Column) -> tuple[DataFrame, Column]:
    """``df`` with its ``chunk``, and the micro-batch that takes it, with those next to it: a micro-batch costs a second or more, however small its chunk. For operators that deal with the chunks of a micro-batch one by one."""
    rows = df.withColumn("chunk", chunk.cast("long"))
    return rows, in_chunks("chunk", rows, max(LOADS, -(-df.count() // LOAD_ROWS)))


def flushed(df: DataFrame, chunk: Column, after: str = "INTERVAL 400 DAYS", **values) -> tuple[DataFrame, Column]:
    """``df`` and its chunks with one more row at the end, far beyond all others in ``ts``: it moves the watermark past every window that is still open.

    Its other columns are null but for ``values``: keys of a join have to be known, as Spark drops null ones before they are seen.
    """
    rows = df.withColumn("__c", chunk)
    last = rows.agg((F.max("ts") + F.expr(after)).alias("ts"), (F.coalesce(F.max("__c"), F.lit(0)) + 1).alias("__c")).where("ts IS NOT NULL")
    end = last.select(*((F.col(c) if c in ("ts", "__c") else F.lit(values.get(c))).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return rows.unionByName(end), F.col("__c")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, and read what it wrote: in append mode final rows only, in complete mode the last version of all, in update mode every version of every row."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    with state_store(spark):
        if mode == "append":
            query = writer.format("parquet").option("path", out).outputMode("append").start()
        else:
            query = writer.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def idle(ttl: str | None) -> int | None:
    """Milliseconds of a duration like ``90 minutes``; None: state stays."""
    return None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)


class FrameCounter(StatefulProcessor):
    """Whole frames given out, and samples that wait for the rest of theirs."""

    def __init__(self, unit: int, ttl: int | None) -> None:
        self.unit, self.ttl = unit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("frames", "emitted long, held long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        emitted, held = self.state.get() or (0, 0)
        n, held = divmod(held + sum(int(b["samples"].sum()) for b in rows), self.unit)
        self.state.update((emitted + n, held))
        yield pd.DataFrame({"session": [key[0]], "first_frame": [emitted], "n_frames": [n], "held": [held]})


def assemble_frames(chunks: DataFrame, unit: int = X.FRAME_SAMPLES, ttl: str | None = None) -> DataFrame:
    """Whole frames of each session as chunks arrive, with the partial frame carried on instead of dropped.

    chunks: ``session, seq, samples``. A row a chunk batch: ``first_frame``,
    ``n_frames`` (whole ones), ``held`` (samples that wait). The state of a
    session without chunks for ``ttl`` expires; such a query runs on the clock,
    so Spark always sees a batch to come, and ``replay`` would wait for ever.
    """
    step = FrameCounter(unit, idle(ttl))
    return chunks.groupBy("session").transformWithStateInPandas(step, "session long, first_frame long, n_frames long, held long", "Append", "ProcessingTime" if ttl else "None")


def frame_totals(steps: DataFrame) -> DataFrame:
    """Whole frames of each session, and the samples that wait after its last batch: of those at the last frame the most, as a batch without a whole frame only holds more."""
    return steps.groupBy("session").agg(F.sum("n_frames").alias("n_frames"), F.max_by("held", F.struct(F.col("first_frame") + F.col("n_frames"), "held")).alias("held"))


class FrameReleaser(StatefulProcessor):
    """Steps of a conversation's codes, kept until the frames they belong to go out.

    The chunks of a micro-batch are dealt with one by one, each on what the
    one before has left; the state is written when all of them are. Steps are
    only added to the list that waits, unless a chunk has one of the two steps
    of the frame that all others wait for; then whole frames go out, and the
    list is written anew without them.
    """

    def __init__(self, tau: int, k: int, ttl: int | None) -> None:
        self.tau, self.k, self.ttl = tau, k, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.emitted = handle.getValueState("emitted", "n long", self.ttl)
        self.held = handle.getListState("held", "frame_idx long, codes array<long>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("chunk", kind="stable")
        at, codes = new["frame_idx"].to_numpy(np.int64), np.array(new["codes"].tolist(), np.int64)
        cut = np.flatnonzero(np.diff(new["chunk"])) + 1
        (before,) = self.emitted.get() or (0,)
        emitted, waiting, old, out = before, [], None, []
        for chunk in zip(np.split(at, cut), np.split(codes, cut), strict=True):
            waiting.append(chunk)
            if not np.isin(chunk[0], (emitted, emitted + self.tau)).any():
                continue
            if old is None:  # read once, when it is wanted
                old = list(self.held.get())
                waiting = [(np.array([r[0] for r in old], np.int64), np.array([r[1] for r in old], np.int64).reshape(-1, codes.shape[1])), *waiting]
            at, codes = (np.concatenate(x) for x in zip(*waiting, strict=True))
            frames = assembled(at, codes, emitted, self.tau, self.k)
            waits = (frames == PLACEHOLDER).any(axis=1)
            n = int(waits.argmax()) if waits.any() else len(frames)
            out.append(frames[:n])
            emitted += n
            waiting = [(at[at >= emitted], codes[at >= emitted])]
        rest = [(i, c) for a, b in waiting for i, c in zip(a.tolist(), b.tolist(), strict=True)]
        if old is None:
            self.held.appendList(rest)
            return
        if emitted > before or not old:
            self.emitted.update((emitted,))
        self.held.put(rest) if rest else self.held.clear()
        if emitted > before:
            frames = np.arange(before, emitted)
            yield pd.DataFrame({"conv_id": key[0], "frame_idx": frames, "codes": np.concatenate(out).tolist(), "emitted": frames + 1})


def assembled(at: np.ndarray, codes: np.ndarray, first: int, tau: int, k: int) -> np.ndarray:
    """Frames from ``first`` on whose own step is there, with placeholders for codes that are not: codebook 0 of each role from a frame's own step, the others from the one ``tau`` later."""
    head = np.arange(2 * k) % k == 0
    own = (codes[:, head] != PLACEHOLDER).any(axis=1) & (at >= first)  # steps beyond the last frame have none of their own
    frames = np.full((int((at[own].max(initial=first - 1)) + 1 - first), 2 * k), PLACEHOLDER, np.int64)
    frames[np.ix_(at[own] - first, head)] = codes[np.ix_(own, head)]
    late = (at - tau >= first) & (at - tau < first + len(frames))
    frames[np.ix_(at[late] - tau - first, ~head)] = codes[np.ix_(late, ~head)]
    return frames


def release_frames(steps: DataFrame, tau: int, k: int = X.CODEBOOKS, ttl: str | None = None, chunk: str | None = None) -> DataFrame:
    """Frames of each conversation as soon as all their codes have come: ``conv_id, frame_idx, codes, emitted``.

    steps: ``conv_id, frame_idx, codes`` in the delay pattern, 2 k codes wide:
    codebook 0 of each role belongs to its own frame, the others to the one
    ``tau`` before. Frames whose codes are yet to come, or are placeholders,
    are held with all after them, as order must be kept. ``emitted`` counts the
    tokens (one a frame) given out so far. The state of a conversation without
    steps for ``ttl`` expires. ``chunk``: a column with the number of the chunk
    a step came in, if a micro-batch may have several; else it is one chunk.
    """
    step = FrameReleaser(tau, k, idle(ttl))
    steps = steps.select("conv_id", "frame_idx", "codes", (F.col(chunk) if chunk else F.lit(0)).cast("long").alias("chunk"))
    return steps.groupBy("conv_id").transformWithStateInPandas(step, "conv_id long, frame_idx long, codes array<long>, emitted long", "Append", "ProcessingTime" if ttl else "None")


def energy(events: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Root mean square a tumbling or sliding window. In append mode a window comes out, and leaves the state, when the watermark passes it."""
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_micros"), "event_type", "rms", "n")


def sync_streams(own: DataFrame, user: DataFrame, within: str = "2 minutes") -> DataFrame:
    """Own and user events of one user paired within a time; an event of either side without partner comes out with PAD for the other, once the watermarks rule one out."""
    a = own.select(F.col("user_id").alias("a_user"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = user.select(F.col("user_id").alias("b_user"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    if a.isStreaming:
        a, b = a.withWatermark("a_ts", "1 hour"), b.withWatermark("b_ts", "1 hour")
    near = (F.col("a_user") == F.col("b_user")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}"))
    kind = lambda c: F.when(F.col(c).isNull(), "PAD").otherwise("WORD")
    return a.join(b, near, "full_outer").select("a_id", "b_id", kind("a_id").alias("own"), kind("b_id").alias("user"))


class SessionCutter(StatefulProcessor):
    """Events of a bucket of users that belong to sessions still open, in any order. One timer a bucket wakes it when the watermark reaches the earliest end that a session may have; whatever sessions have ended by then go out."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user array<long>, us array<long>, id array<long>, ends array<boolean>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        wake = []
        for b in rows:
            self.open.appendValue(tuple(b[c].tolist() for c in ("user", "us", "id", "ends")))
            wake.append(int((b["us"] + self.gap * ~b["ends"].astype(bool)).min()))  # a session's end is that of its last event, had it no other
        at, set_ = -(-min(wake) // 1000), [int(t) for t in self.handle.listTimers()]
        if at < min(set_, default=at + 1):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.open.get())
        user, us, ids = (np.array([x for h in held for x in h[c]], np.int64) for c in range(3))
        ends = np.array([x for h in held for x in h[3]], bool)
        order = np.lexsort((ids, us, user))
        user, us, ids, ends = user[order], us[order], ids[order], ends[order]
        start = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | ends[:-1] | (np.diff(us) >= self.gap)])
        n = np.diff(np.r_[start, len(us)])
        last = start + n - 1
        end = np.where(ends[last], us[last], us[last] + self.gap)
        closed = end <= mark
        if closed.all():
            self.open.clear()
        else:
            keep = np.repeat(~closed, n)
            self.open.put([tuple(x[keep].tolist() for x in (user, us, ids, ends))])
            self.handle.registerTimer(-(-int(end[~closed].min()) // 1000))
        if closed.any():
            yield pd.DataFrame({"user_id": None if key[1] else user[start], "start_micros": us[start], "end_micros": end, "n": n})[closed]


SESSION = "user_id long, start_micros long, end_micros long, n long"


def sessions(events: DataFrame, gap: str = "6 hours", end: str | None = None, buckets: int = 256) -> DataFrame:
    """T4: dialogue sessions of a user. One ends after a gap, or with an event of type ``end``: the next event opens another, however soon it comes.

    Events are ordered by ``ts``, then ``event_id``. A stream gives a session
    out when the watermark reaches its end. Its state is that of ``buckets`` of
    users, as a key costs some milliseconds a micro-batch however few rows it
    has; a task holds one bucket's events of a micro-batch and open sessions.
    """
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    ends = (F.col("event_type") == end) if end else F.lit(False)
    e = events.select("user_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(0)).alias("id"), F.coalesce(ends, F.lit(False)).alias("ends"))
    if events.isStreaming:
        user = F.col("user_id").cast("long")
        e = e.withColumns({"user": F.coalesce(user, F.lit(0)), "bucket": F.pmod(F.xxhash64(user), F.lit(buckets)), "nobody": user.isNull()}).drop("user_id")
        return e.withWatermark("ts", "1 hour").groupBy("bucket", "nobody").transformWithStateInPandas(SessionCutter(gap_us), SESSION, "Append", "EventTime")
    by = Window.partitionBy("user_id").orderBy("us", "id")  # the events of one user
    first = F.coalesce(F.lag("ends").over(by) | (F.col("us") - F.lag("us").over(by) >= gap_us), F.lit(True))
    cut = e.withColumn("first", first).withColumn("run", F.sum(F.col("first").cast("int")).over(by)).groupBy("user_id", "run")
    rows = cut.agg(F.min("us").alias("start_micros"), F.max("us").alias("last"), F.bool_or("ends").alias("ends"), F.count("*").alias("n"))
    return rows.select("user_id", "start_micros", F.when(F.col("ends"), F.col("last")).otherwise(F.col("last") + gap_us).alias("end_micros"), "n")


def loss_scale_monitor(metrics: DataFrame, tasks: list[str], size: str = "1 day", alarm: float = 1.2) -> DataFrame:
    """T5: mean a window and task, the largest over the smallest of the window's tasks, and an alarm where one dominates. ``tasks``: any event types; one without events in a window has no mean there."""
    e = metrics.withWatermark("ts", "1 hour") if metrics.isStreaming else metrics
    means = e.groupBy(F.window("ts", size).alias("w")).agg(*(F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in tasks))
    each = F.array(*(F.col(f"`{t}`") for t in tasks))
    ratio = F.array_max(each) / F.array_min(each)
    return means.select(F.unix_micros("w.start").alias("start_micros"), *(f"`{t}`" for t in tasks), ratio.alias("ratio"), (ratio > alarm).alias("alarm"))


def chunk_equals_whole(op: Callable[[DataFrame], DataFrame], df: DataFrame, whole: DataFrame, chunks: dict[int, Column], close: bool = False, loads: bool = False) -> DataFrame:
    """For each size of chunk, the rows of ``op`` run on a stream of such chunks, of the one-shot result ``whole``, and those that only one of them has.

    The streams run side by side: a micro-batch of small chunks leaves most
    cores idle. ``close``: a last row moves the watermark past all windows.
    ``loads``: a micro-batch may have several chunks, which ``op`` tells apart
    by the column ``chunk`` and deals with one by one.
    """
    df, whole = written(df), written(whole)
    with ThreadPoolExecutor(len(chunks)) as pool:
        feed = lambda chunk: Feed(*(in_loads(df, chunk) if loads else flushed(df, chunk) if close else (df, chunk)))
        streamed = pool.map(inheritable_thread_target(df.sparkSession)(lambda chunk: replay(op, feed(chunk))), chunks.values())
        got = dict(zip(chunks, streamed, strict=True))
    rows = whole.withColumns({"chunk": F.explode(F.array(*map(F.lit, chunks))), "g": F.lit(0), "w": F.lit(1)})
    for size, part in got.items():
        rows = rows.unionByName(part.select(*whole.columns, F.lit(size).alias("chunk"), F.lit(1).alias("g"), F.lit(0).alias("w")))
    each = rows.groupBy("chunk", *whole.columns).agg(F.sum("g").alias("g"), F.sum("w").alias("w"))
    return each.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.sum("g").alias("streamed"), F.sum("w").alias("whole"), F.sum(F.abs(F.col("g") - F.col("w"))).alias("differing"))


def merged_counts(events: DataFrame, size: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Rows a window that came in time: ``start_micros, merged``.

    On a stream, rows of a window that the watermark has passed are dropped.
    The watermark that a chunk's rows are held against is that of the newest
    row of all chunks before: ``replay`` waits until a chunk is dealt with, so
    Spark has moved the watermark on. An event that comes twice counts
    once; that step looks at single rows, so Spark's own count of what the
    watermark dropped there is one of rows, not of partial sums.
    """
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    rows = e.select("event_id", F.window("ts", size).alias("w")).dropDuplicates(["event_id", "w"])
    return rows.groupBy("w").agg(F.count("*").alias("merged")).select(F.unix_micros("w.start").alias("start_micros"), "merged")


def dropped_rows(progress: list[dict]) -> dict[int, int]:
    """Rows that the watermark dropped in each micro-batch with input, from 0, by Spark's progress reports: the largest count of its operators, as a row is dropped by the first that sees it."""
    return dict(enumerate(max((o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), default=0) for p in progress if p["numInputRows"]))


def late_rows(events: DataFrame, chunk: Column, size: str = "1 day", watermark: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """The late-data rule. (``start_micros, merged, dropped``: rows by window that a stream, which gets them in the order of ``chunk``, merged and dropped as late; ``batch, dropped``: what the stream itself reports, written as a table)."""
    every = merged_counts(events, size).withColumnRenamed("merged", "n")
    reports: list[dict] = []
    streamed = replay(lambda s: merged_counts(s, size, watermark), Feed(*flushed(events, chunk)), progress=reports)
    j = every.join(streamed, "start_micros", "left")
    by_window = j.select("start_micros", F.coalesce("merged", F.lit(0)).alias("merged"), (F.col("n") - F.coalesce("merged", F.lit(0))).alias("dropped"))
    return by_window, written(events.sparkSession.createDataFrame(sorted(dropped_rows(reports).items()), "batch long, dropped long"))  # a row a micro-batch
