"""Work that grows with rows, not with pairs or with one conversation: against plain windows and joins."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators import frames as R
from framewise.operators import joins as J
from framewise.operators import metrics as A
from framewise.operators import mix as M
from framewise.operators import ranks
from framewise.operators import vectors as E
from framewise.sources import tables as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_scans_in_two_levels(spark, block):
    rng = random.Random(1)
    data = [(rng.choice([1, 2, None]), i * 3 % 101 - 50, rng.choice([None, *range(9)])) for i in range(100)]
    df = spark.createDataFrame(data, "g long, at long, v long")
    by = Window.partitionBy("g").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.max("v").over(upto).alias("a"), F.sum("v").over(upto).alias("b"), F.lag("v").over(by).alias("c"), F.lead("v").over(by).alias("d"), F.first("v").over(upto).alias("e"))
    v = F.col("v")
    assert rows(ranks.scanned(df, ["g"], "at", ["at"], block, a=("max", v), b=("sum", v), c=("prev", v), d=("next", v), e=("first", v))) == rows(want)


def test_turns_in_blocks(spark):
    """W7, W5 and the words view along sessions of several blocks of turns, one without numbers among them, against windows over whole sessions."""
    turns = [(1, t, ("user", "assistant", "user")[t % 3], f"w{t} x") for t in range(0, 30_000, 7)] + [(2, None, "user", "a"), (2, 5, "assistant", "b"), (2, 9_000, "user", None), (3, 1, "user", "only")]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    by = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conv.withColumn("r", F.lead("role").over(by)).withColumn("reply", F.lead("text").over(by)).where("role = 'user' AND r = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "reply")
    assert rows(M.single_turn_pairs(conv)) == rows(pairs)
    tokens = conv.where("turn IS NOT NULL").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("token"))
    out = R.interleave_pad(tokens, 0.5, 3)
    ends = out.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("frame_idx").alias("d"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    assert all(r["n"] == r["d"] == r["b"] + 1 and r["a"] == 0 for r in ends.collect())
    said = out.where("kind = 'WORD'").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("frame_idx")))
    want = tokens.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")))
    assert rows(said.select("conv_id", "i", "token")) == rows(want.select("conv_id", "i", "token"))
    words = S.words_view(conv)
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert all("__b" in line or "turn#" in line.rpartition("[conv_id")[2] for line in plan.splitlines() if line.strip(" :+-").startswith("Window ["))
    by_turn = words.groupBy("conv_id", "turn").agg(F.min("start_frame").alias("a"), F.max(F.col("start_frame") + F.col("n_frames")).alias("b")).where("conv_id = 1")
    steps = by_turn.withColumn("gap", F.col("a") - F.lag("b").over(by)).groupBy().agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.min("a").alias("first")).first()
    assert tuple(steps) == (4286, -4, 6, 0)


def test_no_window_over_a_conversation(spark):
    """What these operators sort is a block of frames: every window but those over block summaries is parted by block too."""
    frames = spark.createDataFrame([(1, i, "WORD" if i % 3 else "PAD", "A") for i in range(50)], "conv_id long, frame_idx long, kind string, zone string")
    plans = [R.mark_epad(frames), R.loss_weights(frames), A.frame_balance(frames)]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window [")]
        assert windows and all("__b" in w for w in windows if "conv_id" in w)
    assert "Window" not in R.complete_prefix(spark.createDataFrame([(1, 1, 0, 5)], "conv_id long, frame_idx long, codebook long, code long"))._jdf.queryExecution().optimizedPlan().toString()


def brute_overlaps(segments):
    out = []
    for c, t, role, a0, a1 in segments:
        for d, u, other, u0, u1 in segments:
            if role == "assistant" and other == "user" and c == d and a0 < u1 and u0 < a1:
                out.append((c, t, u, max(a0, u0), min(a1, u1), "backchannel" if u0 >= a0 and u1 <= a1 else "barge_in" if u0 >= a0 else "overlap"))
    return sorted(out, key=str)


SEGMENTS = "conv_id long, turn long, role string, start_frame long, end_frame long"


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    segs = []
    for t in range(160):
        a = rng.randrange(3000)
        segs.append((t % 3, t, rng.choice(["assistant", "user"]), a, a + rng.choice([0, 1, 5, 255, 256, 257, 900])))
    df = spark.createDataFrame(segs, SEGMENTS)
    assert rows(J.overlaps(df)) == brute_overlaps(segs)


def test_long_sessions_are_not_compared_in_pairs(spark):
    """A session of 100,000 turns: each assistant turn meets its bin's user turns, not all 50,000."""
    turns = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), (F.col("id") * 20).alias("start_frame"), (F.col("id") * 20 + 25).alias("end_frame"))
    a, u = (turns.where(F.col("role") == r).select("conv_id", F.col("start_frame").alias(f"{r[0]}0"), F.col("end_frame").alias(f"{r[0]}1")) for r in ("assistant", "user"))
    met = J.binned(a, "a0", "a1").join(J.binned(u, "u0", "u1"), ["conv_id", "bin"]).count()
    assert met < 20 * 100_000
    assert J.overlaps(turns).count() == 99_999


def test_merged_intervals_and_points(spark):
    rng = random.Random(3)
    spans = [(rng.randrange(2), a := rng.randrange(4000), a + rng.choice([0, 1, 3, 300, 700])) for _ in range(60)]
    covered = {(c, f) for c, a, b in spans for f in range(a, b)}
    merged = rows(J.merged_intervals(spark.createDataFrame(spans, "conv_id long, start_frame long, end_frame long")))
    assert {(c, f) for c, a, b in merged for f in range(a, b)} == covered
    assert all(not (c == d and a < y and x < b) for i, (c, a, b) in enumerate(merged) for d, x, y in merged[:i])
    points = [(c, f, f * c) for c in (0, 1, 2) for f in range(0, 4800, 7)]
    got = J.within_intervals(spark.createDataFrame(points, "conv_id long, frame_idx long, x long"), spark.createDataFrame(spans, "conv_id long, start_frame long, end_frame long"))
    assert {(r["conv_id"], r["frame_idx"]) for r in got.collect()} == {(c, f) for c, f, _ in points if (c, f) in covered} and got.columns == ["conv_id", "frame_idx", "x"]


def test_drift_counts_overlap_frames_only(spark):
    frames = spark.createDataFrame([(1, 5, 0, 0.9), (1, 50, 0, 0.1), (1, 6, 1, 0.5), (2, 5, 1, 0.0)], "conv_id long, frame_idx long, step long, similarity double")
    spans = spark.createDataFrame([(1, 0, 10), (1, 4, 20)], "conv_id long, start_frame long, end_frame long")
    assert rows(E.voice_drift_guard(frames, spans, 0.6)) == [(0, 0.9, None, False), (1, 0.5, pytest.approx(-0.4), True)]


def test_sketches_are_near_the_exact_values_at_all_levels(spark):
    """Languages and the corpus, made of the conversations' sketches, are as exact as those."""
    segs = spark.range(60_000).select((F.col("id") % 300).alias("conv_id"), F.floor(F.col("id") / 300).alias("turn"), F.when(F.col("id") % 600 < 300, "assistant").otherwise("user").alias("role"), (F.floor(F.col("id") / 300) * 100 + F.pmod(F.xxhash64("id"), F.lit(97))).alias("start_frame")).withColumn("end_frame", F.col("start_frame") + 30)
    langs = spark.range(300).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, "ko").otherwise("en").alias("lang"))
    got = {(r["level"], r["key"]): r for r in A.turn_levels(segs, langs).collect()}
    assert sum(k[0] == "conversation" for k in got) == 300 and got["corpus", None]["turns"] == 60_000
    gaps = A.gaps(segs).join(langs, "conv_id").where("gap IS NOT NULL").select("lang", "gap").toPandas()
    for key, part in [("ko", gaps[gaps.lang == "ko"]), ("en", gaps[gaps.lang == "en"]), (None, gaps)]:
        r = got["corpus" if key is None else "language", key]
        for q, v in ((0.5, r["median_gap"]), (0.9, r["p90_gap"])):
            assert (part.gap < v).mean() - 0.02 <= q <= (part.gap <= v).mean() + 0.02
        assert r["overlap_share"] == pytest.approx((part.gap < 0).mean())


def test_voice_estimates(spark):
    df = spark.range(30_000).select((F.col("id") % 4).alias("part"), (F.col("id") % 7000).alias("voice"))
    got = {(r["part"], r["every"]): (r["voices"], r["n"]) for r in A.voice_levels(df, "part").collect()}
    exact = {(p, False): len({i % 7000 for i in range(p, 30_000, 4)}) for p in range(4)} | {(None, True): 7000}
    assert got.keys() == exact.keys() and all(abs(got[k][0] - n) <= 0.06 * n for k, n in exact.items())
    assert got[None, True][1] == 30_000


def test_leaks_with_broadcast_off(spark):
    """The filter goes before the shuffle: hits are shuffled, and no leak is lost."""
    rng = random.Random(5)
    held = [[f"h{rng.randrange(5000)}" for _ in range(30)] for _ in range(40)]
    train = [(i, " ".join([f"t{rng.randrange(5000)}" for _ in range(60)] + (held[i % 40][k : k + 8] if i % 9 == 0 else held[i % 40][:7] if i % 9 == 1 else []))) for i in range(300) for k in [rng.randrange(20)]]
    docs = spark.createDataFrame(train, "doc_id long, text string").repartition(3)
    probe = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(held)], "item_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"] for r in J.leak_flags(docs, probe).where("leaks").collect()}
        grams, hashes = J.gram_hashes(docs, ["doc_id"], 8), J.gram_hashes(probe, [], 8).distinct()
        passed, hits, every = J.maybe_held(grams, hashes).count(), grams.join(hashes, "h", "left_semi").count(), grams.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i for i in range(300) if i % 9 == 0}
    assert hits <= passed <= hits + 0.001 * every


def test_keys_with_an_offset(spark):
    keys = [("t.0.w",), ("t.11.w",), ("norm",), ("t.x.w",), (None,)]
    df = spark.createDataFrame(keys, "key string")
    got = [r[0] for r in df.select(J.mapped_key(F.col("key"), r"^t\.([0-9]+)\.w$", "u.{n}.w", 8)).collect()]
    assert got == ["u.8.w", "u.19.w", "norm", "t.x.w", None]
    ledger = J.reconcile(spark.createDataFrame([("t.8.w", 1), ("t.9.w", 2), ("norm", 3)], "key string, shape int"), spark.createDataFrame([("t.0.w", 1), ("t.1.w", 5), ("head", 3)], "key string, shape int"), r"^t\.([0-9]+)\.w$", "t.{n}.w", ["head"], -8)
    assert rows(ledger) == [("head", "kept", False), ("norm", "unused", True), ("t.0.w", "copied", False), ("t.1.w", "mismatched", True)]


def test_filters_that_agree(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "x long")
    got = M.filters_agree(df, {"a": df.where("x > 1"), "b": df.where("x < 5"), "c": df.where("x <> 3")})
    assert rows(got) == [(0, "dropped_by_a"), (1, "dropped_by_a"), (2, "kept_by_all"), (3, "dropped_by_c"), (4, "kept_by_all"), (5, "dropped_by_b")]
    assert rows(M.filters_agree(df, {"a": df.where("x > 4")})) == [*((i, "dropped_by_a") for i in range(5)), (5, "kept_by_all")]


def test_tail_window_goes(spark):
    s = spark.createDataFrame([(1, "user", 0, 3.0), (1, "user", 9, 4.0), (1, "user", 10, 9.0), (2, "user", 0, 1.0), (2, "user", 19, 1.0)], "session long, role string, micros long, value double")
    got = {(r["session"], r["win"]) for r in A.rms_energy(s, 10, 0.0).collect()}
    assert got == {(1, 0), (2, 0), (2, 1)}


def test_sql_functions(spark):
    X.register_sql(spark)
    X.register_sql_check(spark, "shouts", "text = upper(text)", "BOOLEAN")
    spark.createDataFrame([(1, "가나 abc"), (2, " \t\n"), (3, "A B A B A B"), (4, "")], "id long, text string").createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT id, script_ratio(text), english_ratio(text), word_limit(text, 2), is_blank(text), repetition_rate(text), shouts(text) FROM odd_texts ORDER BY id").collect()
    df = spark.table("odd_texts").orderBy("id")
    want = df.select("id", X.script_ratio(F.col("text")), X.english_ratio(F.col("text")), X.word_limit_compliance(F.col("text"), 2), X.is_empty(F.col("text")), X.repetition_rate(F.col("text")), F.col("text") == F.upper("text")).collect()
    assert list(map(tuple, got)) == list(map(tuple, want))


def test_buckets_follow_the_rows():
    assert ranks.hash_bits(10) == ranks.hash_bits(25_000_000) == 8 and ranks.hash_bits(10**10) == 17 and ranks.hash_bits(10**18) == 32


def test_samples_within_spans_are_not_shuffled_in_pairs(spark, monkeypatch):
    """A14 over pairs tested where they arise: as the semi-join of all pairs, which no exchange carries."""
    monkeypatch.setattr(E, "BLOCK", 4)
    samples = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("step"), (F.col("id") / 40).alias("similarity"))
    convs = spark.range(60).select(F.col("id").alias("conv_id"), (F.col("id") % 3).alias("k"))
    spans = spark.range(90).select((F.col("id") % 45).alias("conv_id"), (F.col("id") * 7 % 90).alias("start_frame"), (F.col("id") * 7 % 90 + 9).alias("end_frame"))
    frame = X.hash32(F.concat_ws(":", "row_id", "conv_id")) % 100
    points = samples.join(convs, "k").select("conv_id", frame.alias("frame_idx"), "step", "similarity")
    got = E.sampled_within(samples, convs, spans, frame, 100)
    assert rows(got) == rows(J.within_intervals(points, spans).select("step", "similarity")) != []
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "md5" in plan.lower()  # pairs arise in the one join, and are tested there
    assert sorted(rows(got.withColumn("similarity", F.round("similarity", 9)))) == sorted(rows(J.within_intervals(points, spans).select("step", F.round("similarity", 9))))


def test_runs_are_their_frames(spark):
    """J1, W2 and W8 in runs give the frames that they give on frames; no frame is shuffled."""
    words = spark.createDataFrame([(1, 0, 0, "a", 3), (1, 0, 1, "b", 3), (1, 0, 2, None, 7), (1, 1, 0, "c", 8), (1, 1, 1, "d", 60), (2, 0, 0, "e", -2), (2, 0, 1, "f", 0), (4, 0, 0, "g", 1)], "conv_id long, turn long, word_idx long, word string, start_frame long")
    horizon = spark.createDataFrame([(1, 55), (2, 9), (3, 4), (5, 0)], "conv_id long, n_frames long")
    frames = R.align_words(words, horizon)
    spoken = {(1, 3): "a", (1, 4): "b", (1, 8): "c", (2, 0): "f"}
    assert rows(frames) == sorted([(c, i, "WORD" if (c, i) in spoken else "PAD", spoken.get((c, i))) for c, n in ((1, 55), (2, 9), (3, 4)) for i in range(n)], key=str)
    runs = R.align_runs(words, horizon)
    assert runs.count() < 15
    marked, of = R.mark_epad(runs), ["conv_id", "frame_idx", "kind", "word"]
    assert rows(R.expanded(marked).select(of)) == rows(R.mark_epad(frames).select(of))
    zone = lambda df: df.withColumn("zone", F.when(F.col("frame_idx") < 6, "A").when(F.col("frame_idx") < 50, "B").otherwise("C"))
    weighed = R.expanded(R.loss_weights(zone(R.cut_runs(marked, [6, 50]))))
    assert rows(weighed.select(*of, "zone", "weight")) == rows(R.loss_weights(zone(R.mark_epad(frames))).select(*of, "zone", "weight"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_compared_by_frame(spark):
    """Arrays of codes join a row a frame, with the result of a row a code."""
    from framewise.operators import joins as J

    a = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [3, None]), (2, 0, [5])], "conv_id long, frame_idx long, codes array<long>")
    b = spark.createDataFrame([(1, 0, [1, 9]), (1, 1, [3, 4, 5]), (3, 0, [7])], "conv_id long, frame_idx long, codes array<long>")
    each = lambda df: df.select("conv_id", "frame_idx", F.posexplode("codes").alias("codebook", "code"))
    assert J.code_agreement(a, b).collect() == J.code_agreement(each(a), each(b)).collect() == [(2 / 3, -2, None)]


def test_ratios_share_one_scan(spark, monkeypatch):
    """A3: the tokens are scanned once, whatever the number of ratios; the streams are those of each ratio alone."""
    from framewise.operators import frames as R

    scanned, rows = R.scanned, []
    monkeypatch.setattr(R, "scanned", lambda df, *a, **k: rows.append(df.count()) or scanned(df, *a, **k))
    tokens = spark.range(60).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("token"))
    every = R.interleave_pads(tokens, [0.0, 0.5, 0.8], 1)
    assert rows == [60]
    for ratio in (0.0, 0.5, 0.8):
        assert sorted(every.where(F.col("ratio") == ratio).drop("ratio").collect(), key=str) == sorted(R.interleave_pad(tokens, ratio, 1).collect(), key=str)


def test_flags_are_scanned_without_a_sort_of_all_rows(spark):
    """V1: ends of blocks are hashed, so only a block's rows are sorted; W3 makes its frames once."""
    from framewise.operators import validate as V

    frames = spark.createDataFrame([(1, i, k) for i, k in enumerate(("EPAD", "WORD", "EPAD", "PAD", "EPAD"))], "conv_id long, frame_idx long, kind string")
    bad = V.check_epad(frames)
    assert sorted(r["frame_idx"] for r in bad.collect()) == [2, 4]
    assert "SortAggregate" not in _plan(bad)


def test_text_delay_makes_its_frames_once(spark, monkeypatch):
    from framewise.plans import catalog

    made, runs = [], catalog.Views.runs.fget
    monkeypatch.setattr(catalog.Views, "runs", property(lambda v: made.append(1) or runs(v)))
    catalog.queries()["w3_text_delay"](spark, "/root/testdata/sf0.001")
    assert made == [1]
