"""Joins: agreement, overlaps, nearest events, pairing, disjointness, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators.ranks import by_hash, scanned
from framewise.session import written


def code_agreement(a: DataFrame, b: DataFrame, text_a: DataFrame | None = None, text_b: DataFrame | None = None) -> DataFrame:
    """Share of equal codes of two runs of one stream, the difference of their row counts, and whether their texts (``conv_id, frame_idx, word``) are equal (null without texts).

    Runs are a row a code (``conv_id, frame_idx, codebook, code``), or a row a frame with an array of ``codes`` by codebook: so the join has a row a frame.
    """
    keys = ["conv_id", "frame_idx", "codebook"]
    if "codes" in a.columns:
        j = a.join(b.withColumnRenamed("codes", "other"), keys[:2], "full_outer")
        n = lambda c: F.coalesce(F.sum(F.size(F.array_compact(c))), F.lit(0))
        pairs = F.filter(F.arrays_zip("codes", "other"), lambda x: x["codes"].isNotNull() & x["other"].isNotNull())
        j = j.withColumn("both", F.size(pairs)).withColumn("same", F.size(F.filter(pairs, lambda x: x["codes"] == x["other"])))
        known = lambda c: F.sum(F.when(F.col("codes").isNotNull() & F.col("other").isNotNull(), F.col(c)))
        share = F.try_divide(known("same").cast("double"), known("both").cast("double"))
        codes = j.agg(share.alias("agreement"), (n(F.coalesce("codes", F.array().cast("array<long>"))) - n(F.coalesce("other", F.array().cast("array<long>")))).alias("row_difference"), F.lit(None).cast("boolean").alias("text_equal"))
    else:
        j = a.join(b.withColumnRenamed("code", "other"), keys, "full_outer")
        both = F.col("code").isNotNull() & F.col("other").isNotNull()
        codes = j.agg(F.avg(F.when(both, (F.col("code") == F.col("other")).cast("double"))).alias("agreement"), (F.count("code") - F.count("other")).alias("row_difference"), F.lit(None).cast("boolean").alias("text_equal"))
    if text_a is None or text_b is None:
        return codes
    t = text_a.select(*keys[:2], "word").join(text_b.select(*keys[:2], F.col("word").alias("other")), keys[:2], "full_outer")
    equal = t.agg(F.lit(None).cast("double").alias("agreement"), F.lit(None).cast("long").alias("row_difference"), F.coalesce(F.bool_and(F.col("word").eqNullSafe(F.col("other"))), F.lit(True)).alias("text_equal"))
    return codes.unionByName(equal).agg(*(F.max(c).alias(c) for c in codes.columns))


def signal_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference over the root mean square of ``b``, over their common keys."""
    j = a.select("event_id", F.col("value").alias("x")).join(b.select("event_id", F.col("value").alias("y")), "event_id")
    return j.agg((F.max(F.abs(F.col("x") - F.col("y"))) / F.sqrt(F.avg(F.col("y") * F.col("y")))).alias("error"))


#: Frames of a time bin of interval joins: some 20 seconds.
BIN = 256


def binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` once for each time bin (``bin``) that frames ``start`` to ``end`` (exclusive) touch."""
    low = F.floor(F.col(start) / BIN)
    return rows.withColumn("bin", F.explode(F.sequence(low, F.greatest(low, F.floor((F.col(end) - 1) / BIN)))))


def overlaps(segments: DataFrame) -> DataFrame:
    """Times that assistant and user segments share.

    Segments meet within time bins of a conversation, so what is looked at
    grows with the segments of a conversation, not with their pairs; a pair
    counts in its first shared bin. ``kind``: backchannel if the user's
    segment lies within the assistant's, barge_in if the user starts within
    it, else overlap.
    """
    a = segments.where("role = 'assistant'").select("conv_id", F.col("turn").alias("a_turn"), F.col("start_frame").alias("a0"), F.col("end_frame").alias("a1"))
    u = segments.where("role = 'user'").select("conv_id", F.col("turn").alias("u_turn"), F.col("start_frame").alias("u0"), F.col("end_frame").alias("u1"))
    j = binned(a, "a0", "a1").join(binned(u, "u0", "u1"), ["conv_id", "bin"]).where("a0 < u1 AND u0 < a1").where(F.col("bin") == F.floor(F.greatest("a0", "u0") / BIN))
    kind = F.when((F.col("u0") >= F.col("a0")) & (F.col("u1") <= F.col("a1")), "backchannel").when(F.col("u0") >= F.col("a0"), "barge_in").otherwise("overlap")
    return j.select("conv_id", "a_turn", "u_turn", F.greatest("a0", "u0").alias("start_frame"), F.least("a1", "u1").alias("end_frame"), kind.alias("kind"))


def merged_intervals(spans: DataFrame) -> DataFrame:
    """``conv_id, start_frame, end_frame`` of the intervals that ``spans`` cover together: a sweep in the order of their starts, where one begins that no earlier one reaches."""
    once = spans.where("start_frame < end_frame").groupBy("conv_id", "start_frame").agg(F.max("end_frame").alias("end_frame"))
    along = (["conv_id"], "start_frame", ["start_frame"])
    rows = scanned(once, *along, reach=("max", F.col("end_frame")))
    rows = scanned(rows, *along, before=("prev", F.col("reach")))
    rows = scanned(rows, *along, run=("sum", F.when(F.coalesce(F.col("before") >= F.col("start_frame"), F.lit(False)), 0).otherwise(1)))
    return rows.groupBy("conv_id", "run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("run")


def within_intervals(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``points`` (``conv_id, frame_idx``, further columns) that lie in one of ``spans``: a semi-join by time bin with the merged intervals, of which a bin has few."""
    i = binned(merged_intervals(spans), "start_frame", "end_frame").select(F.col("conv_id").alias("__conv"), F.col("bin").alias("__bin"), "start_frame", "end_frame")
    i = i.withColumnsRenamed({"start_frame": "__from", "end_frame": "__to"})
    inside = (F.col("conv_id") == F.col("__conv")) & (F.floor(F.col("frame_idx") / BIN) == F.col("__bin")) & (F.col("frame_idx") >= F.col("__from")) & (F.col("frame_idx") < F.col("__to"))
    return points.join(i, inside, "left_semi")


def event_alignment(teacher: DataFrame, student: DataFrame, tolerance: int) -> DataFrame:
    """The nearest student event within ``tolerance`` frames, ties to the earlier; nulls where there is none.

    Both sides carry ``session, event_id, frame``. Time is cut into buckets of
    ``tolerance``. The last student before and the first after an event lie in
    its own bucket, where one window over both sides finds them, or are the
    last of the bucket before and the first of the next. So rows grow with the
    events, not with their pairs, and a long session is many buckets.
    """
    at = ["session", "bucket"]
    bucket = F.floor(F.col("frame") / tolerance).alias("bucket")
    none = F.lit(None).cast("struct<frame:bigint,id:bigint>")
    s = student.select("session", bucket, "frame", F.col("event_id").cast("long").alias("id"))
    pair = F.struct(F.col("frame").cast("long").alias("frame"), F.col("id"))
    rows = teacher.select("session", bucket, "frame", "event_id", none.alias("s")).unionByName(s.select(*at, "frame", F.lit(None).cast(teacher.schema["event_id"].dataType).alias("event_id"), pair.alias("s")))
    # Of students on one frame the smallest id counts: it is the last before and the first after.
    up = Window.partitionBy(*at).orderBy("frame", F.col("s").isNull(), F.col("s.id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*at).orderBy("frame", F.col("s").isNotNull(), "s.id").rowsBetween(0, Window.unboundedFollowing)
    own = rows.withColumn("before", F.last("s", True).over(up)).withColumn("after", F.first("s", True).over(down)).where("s IS NULL")
    ends = s.groupBy(*at).agg(F.max(F.struct(F.col("frame").cast("long").alias("frame"), (-F.col("id")).alias("id"))).alias("last"), F.min(pair).alias("first"))
    ends = ends.select(*at, F.struct("last.frame", (-F.col("last.id")).alias("id")).alias("last"), "first")
    left = ends.select("session", (F.col("bucket") + 1).alias("bucket"), F.col("last").alias("left"))
    right = ends.select("session", (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("right"))
    j = own.join(left, at, "left").join(right, at, "left")
    found = F.transform(F.array("before", "after", "left", "right"), lambda x: F.struct(F.abs(x["frame"] - F.col("frame")).alias("d"), x["frame"].alias("frame"), x["id"].alias("id")))
    best = F.array_min(F.filter(found, lambda x: x["d"] <= tolerance))
    return j.withColumn("m", best).select("session", "event_id", F.col("m.id").alias("student_id"), (F.col("m.frame") - F.col("frame")).alias("frame_offset"))


def pair_reference_voice(samples: DataFrame, pool: DataFrame, epoch: int) -> DataFrame:
    """A voice of the pool for each sample and epoch, by hash, never its own. samples: ``sample_id, own_voice``; pool: ``voice``.

    Null where the pool has no other voice. The pool is a table of reference
    voices; Spark broadcasts it if it is small.
    """
    ranked = by_hash(pool.select("voice"), [], "voice", "slot")
    n = F.lit(max(1, pool.count()))
    h = X.hash32(F.concat_ws(":", F.col("sample_id"), F.lit(epoch)))
    j = samples.withColumn("slot", h % n).join(ranked, "slot", "left")
    again = ranked.select(F.col("slot").alias("next_slot"), F.col("voice").alias("next_voice"))
    j = j.withColumn("next_slot", (F.col("slot") + 1) % n).join(again, "next_slot", "left")
    own = lambda c: F.coalesce(F.col(c) == F.col("own_voice"), F.lit(False))
    return j.select("sample_id", F.when(~own("voice"), F.col("voice")).when(~own("next_voice"), F.col("next_voice")).alias("voice"))


def word_grams(df: DataFrame, key: str, n: int) -> DataFrame:
    """``key, gram`` of the distinct lower-case word n-grams of each text."""
    w = X.words(F.lower("text"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return df.select(key, w.alias("w")).where(F.size("w") >= n).select(key, F.explode(F.array_distinct(grams)).alias("gram"))


def gram_hashes(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys, h``: 64-bit hashes of the word n-grams, of which no string is made."""
    w = X.words(F.lower("text"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))
    return df.select(*keys, w.alias("w")).where(F.size("w") >= n).select(*keys, F.explode(grams).alias("h"))


#: Bits of the filter of held-out n-grams, as a power of two: 16 MB in blocks of 4 kB.
FILTER_BITS = 27


def maybe_held(grams: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of ``grams`` whose hash ``h`` may be in ``held``: none of these is lost, others pass as rarely as the filter has bits set.

    The filter is a bit a remainder of a hash, in blocks, so it has the same
    bounded size whatever is held out, and is broadcast where the hashes are
    too many. What passes is still to be joined.
    """
    at = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = held.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(0x7FFF))).alias("bitmap"))
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, cast((h & {0x7FFF}) div 8 + 1 AS int), 1)")), 16, 10).cast("int")
    rows = grams.withColumn("block", F.shiftright(at, 15)).join(F.broadcast(written(bits)), "block")
    return rows.withColumn("__byte", byte).where(F.expr("(__byte div cast(power(2, h & 7) AS int)) % 2 = 1")).select(*grams.columns)


def leak_flags(train: DataFrame, probe: DataFrame, n: int = 8) -> DataFrame:
    """``train`` with ``leaks``: whether a document shares a word n-gram with held-out items.

    The held-out side is written, so Spark knows whether it can be broadcast;
    then only hits among the training n-grams are ever shuffled. Where it is
    larger than Spark broadcasts, a filter of bounded size goes before the
    shuffle (see ``maybe_held``), so it is again the hits that move. Documents
    whose hashes hit are compared by the n-grams themselves.
    """
    spark = train.sparkSession
    held = written(gram_hashes(probe, [], n).distinct())
    grams = gram_hashes(train, ["doc_id"], n)
    if 8 * held.count() > size_limit(spark):
        grams = maybe_held(grams, held)
    maybe = written(grams.join(held, "h", "left_semi").select("doc_id").distinct())
    grams = word_grams(train.join(maybe, "doc_id", "left_semi"), "doc_id", n)
    hit = grams.join(word_grams(probe, "item_id", n).select("gram").distinct(), "gram", "left_semi").select("doc_id").distinct()
    return train.join(written(hit.withColumn("__hit", F.lit(True))), "doc_id", "left").withColumn("leaks", F.col("__hit").isNotNull()).drop("__hit")


def size_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a table; -1 where it never does."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def disjoint_from(train: DataFrame, probe: DataFrame, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """(leaks, clean): training documents that share a word n-gram with held-out items, and all others."""
    flagged = leak_flags(train, probe, n)
    return flagged.where("leaks").drop("leaks"), flagged.where("NOT leaks").drop("leaks")


def mapped_key(key: Column, pattern: str, replacement: str, offset: int = 0) -> Column:
    """``key`` with what fits ``pattern`` replaced; ``{n}`` in the replacement is the pattern's first group, a number, plus ``offset``. A key that doesn't fit stays."""
    number = F.regexp_extract(key, pattern, 1) if "{n}" in replacement else F.lit("")
    shifted = F.coalesce((F.when(number != "", number).cast("long") + offset).cast("string"), F.lit(""))
    return F.when(key.rlike(pattern), F.replace(F.regexp_replace(key, pattern, replacement), F.lit("{n}"), shifted)).otherwise(key)


def reconcile(source: DataFrame, target: DataFrame, pattern: str, replacement: str, allowed: list[str], offset: int = 0) -> DataFrame:
    """Ledger of two catalogs ``key, shape``: source keys are mapped (see ``mapped_key``), then copied, mismatched, kept (target only) or unused (source only); ``failed`` unless the key is a known gap.

    With an offset, a table of a role takes the source table as many places
    further on; a target key that two sources would map to can't arise, as
    numbers stay distinct.
    """
    s = source.select(mapped_key(F.col("key"), pattern, replacement, offset).alias("key"), F.col("shape").alias("source_shape"))
    j = s.join(target.withColumnRenamed("shape", "target_shape"), "key", "full_outer")
    status = F.when(F.col("source_shape").isNull(), "kept").when(F.col("target_shape").isNull(), "unused").when(F.col("source_shape") == F.col("target_shape"), "copied").otherwise("mismatched")
    return j.withColumn("status", status).select("key", "status", ((F.col("status") != "copied") & ~F.col("key").isin(*allowed)).alias("failed"))


def skeleton_slots(slots: DataFrame, utterances: DataFrame, tolerance: int = 8) -> DataFrame:
    """For each slot the utterance of closest length within ``tolerance`` frames, ties to the smaller id, and the stretch it needs.

    Only the smallest id of each length can win, and slots of one length share
    an answer: lengths meet lengths, rows only look theirs up.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    wanted = slots.select("slot_frames").distinct().withColumn("bucket", bucket("slot_frames"))
    there = utterances.groupBy("utt_frames").agg(F.min("utt_id").alias("utt_id"))
    there = there.withColumn("bucket", F.explode(F.array(*(bucket("utt_frames") + d for d in (-1, 0, 1)))))
    near = wanted.join(there, "bucket").where(F.abs(F.col("slot_frames") - F.col("utt_frames")) <= tolerance)
    best = near.groupBy("slot_frames").agg(F.min(F.struct(F.abs(F.col("slot_frames") - F.col("utt_frames")).alias("d"), "utt_id", "utt_frames")).alias("m"))
    return slots.join(best, "slot_frames").select("slot_id", F.col("m.utt_id").alias("utt_id"), (F.col("slot_frames") / F.col("m.utt_frames")).alias("stretch"))


def swap_guard(codes: DataFrame) -> DataFrame:
    """Frames where just one of the two streams is there."""
    side = lambda lo, hi, name: codes.where(F.col("codebook").between(lo, hi) & F.col("code").isNotNull()).select("conv_id", "frame_idx").distinct().withColumn(name, F.lit(True))
    j = side(0, X.CODEBOOKS - 1, "has_self").join(side(X.CODEBOOKS, 2 * X.CODEBOOKS - 1, "has_user"), ["conv_id", "frame_idx"], "full_outer")
    return j.where("has_self IS NULL OR has_user IS NULL").select("conv_id", "frame_idx", F.when(F.col("has_self").isNull(), "self").otherwise("user").alias("missing"))
