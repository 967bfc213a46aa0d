"""Evaluation reports and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators.joins import overlaps
from framewise.operators.ranks import exact_median, scanned
from framewise.session import written


def adherence_report(gens: DataFrame, score: Column, baseline: str = "open") -> DataFrame:
    """A1: mean score of what isn't empty (null if all is), share of empties, and difference to the baseline condition."""
    empty = X.is_empty(F.col("text"))
    by = gens.groupBy("probe", "condition").agg(F.avg(F.when(~empty, score)).alias("score"), F.avg(empty.cast("double")).alias("empty_rate"))
    base = F.max(F.when(F.col("condition") == baseline, F.col("score"))).over(Window.partitionBy("probe"))
    return by.select("probe", "condition", "score", "empty_rate", (F.col("score") - base).alias("delta"), F.col("score").isNull().alias("all_empty"))


def coherence_report(gens: DataFrame) -> DataFrame:
    """A2: repetition and length of non-empty texts by condition."""
    full = gens.where(~X.is_empty(F.col("text")))
    return full.groupBy("condition").agg(F.avg(X.repetition_rate(F.col("text"))).alias("repetition"), F.avg(F.size(X.words(F.col("text")))).alias("words"))


def softmax(logits: DataFrame) -> DataFrame:
    """stable softmax by item."""
    by = Window.partitionBy("item")
    e = F.exp(F.col("logit") - F.max("logit").over(by))
    return logits.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(by)).drop("e")


def token_rank(logits: DataFrame) -> DataFrame:
    """1 + tokens with a higher logit than the target's, by conditional count: one shuffle, no sort."""
    t = F.max(F.when(F.col("token_id") == F.col("target"), F.col("logit"))).over(Window.partitionBy("item"))
    return logits.withColumn("t", t).groupBy("item").agg((1 + F.count_if(F.col("logit") > F.col("t"))).alias("rank"))


def density_sweep(streams: DataFrame, score: Column, horizon: int) -> DataFrame:
    """A3: by PAD ratio: frames, share of PAD and EPAD, mean stream length, and of what is said in the first ``horizon`` frames the share of empties and the mean score of the rest.

    streams: ``ratio, conv_id, frame_idx, kind, token``; score: of the column ``text``.
    """
    # Frames are counted by hash first; only what is said early keeps a row of its own, so lists are made of few rows.
    spoken = (F.col("kind") == "WORD") & (F.col("frame_idx") < horizon)
    early = F.when(spoken, F.struct("frame_idx", "token")).alias("x")
    some = streams.groupBy("ratio", "conv_id", early).agg(F.count("*").alias("frames"), F.count_if(F.col("kind") != "WORD").alias("pads"))
    said = F.flatten(F.collect_list(F.when(F.col("x").isNotNull(), F.array_repeat("x", F.col("frames").cast("int")))))
    by = some.groupBy("ratio", "conv_id").agg(F.sum("frames").alias("frames"), F.sum("pads").alias("pads"), said.alias("said"))
    by = by.withColumn("text", F.array_join(F.transform(F.sort_array("said"), lambda x: x["token"]), " "))
    empty = X.is_empty(F.col("text"))
    return by.groupBy("ratio").agg(
        F.sum("frames").alias("frames"), (F.sum("pads") / F.sum("frames")).alias("pad_share"), F.avg("frames").alias("mean_length"),
        F.avg(empty.cast("double")).alias("empty_rate"), F.avg(F.when(~empty, score)).alias("score"),
    )


def reflex_summary(ranked: DataFrame) -> DataFrame:
    """A4: mean and median probability and rank of the target, number of first ranks, and the verdict. ranked: ``item, rank, p``."""
    rows = written(ranked.select("rank", "p"))
    p, rank = exact_median(rows, "p"), exact_median(rows, "rank")
    return rows.agg(
        F.avg("p").alias("mean_p"), F.lit(p).cast("double").alias("median_p"), F.avg("rank").alias("mean_rank"), F.lit(rank).cast("double").alias("median_rank"), F.count_if(F.col("rank") == 1).alias("n_first"),
        F.lit("reflex" if rank is not None and rank <= 2 else "no reflex").alias("verdict"),
    )


def rms_energy(signal: DataFrame, window_micros: int, threshold: float) -> DataFrame:
    """A5: root mean square a window and role; label: user above the threshold first, then assistant, else silence.

    The tail goes: a session's last window counts only if its signal lasts to the window's end.
    """
    w = F.floor(F.col("micros") / window_micros)
    ends = signal.groupBy("session").agg(F.max("micros").alias("end"))
    signal = signal.join(ends, "session").where((w + 1) * window_micros - 1 <= F.col("end"))
    by = signal.groupBy("session", w.alias("win")).agg(*(F.sqrt(F.avg(F.when(F.col("role") == r, F.col("value") * F.col("value")))).alias(f"{r}_rms") for r in ("user", "assistant")))
    label = F.when(F.coalesce("user_rms", F.lit(0.0)) > threshold, "user").when(F.coalesce("assistant_rms", F.lit(0.0)) > threshold, "assistant").otherwise("silence")
    return by.withColumn("label", label)


def pad_share(frames: DataFrame) -> DataFrame:
    """Shares of PAD, EPAD and words by conversation and in all (null conversation), by rollup."""
    return frames.rollup("conv_id").agg(*((F.count_if(F.col("kind") == k) / F.count("*")).alias(k.lower()) for k in ("PAD", "EPAD", "WORD")))


def weighted_loss_mass(tokens: DataFrame) -> DataFrame:
    """Weight by zone and kind, by zone, and in all. tokens: ``zone, kind, weight``."""
    by = tokens.groupingSets([[F.col("zone"), F.col("kind")], [F.col("zone")], []], "zone", "kind").agg(F.sum("weight").alias("mass"))
    total = F.max(F.when(F.col("zone").isNull(), F.col("mass"))).over(Window.partitionBy(F.lit(1)))  # a row a group
    return by.withColumn("share", F.col("mass") / total)


def task_lang_association(rows: DataFrame) -> DataFrame:
    """Chi-square and Cramer's V of language by structure. rows: ``lang, structure``.

    chi-square = n * (sum of cell^2 / (row sum * column sum) - 1): cells that
    are empty add nothing, so each cell only looks up its two margins.
    """
    c = rows.cube("lang", "structure").agg(F.count("*").alias("n"))
    cell = c.where("lang IS NOT NULL AND structure IS NOT NULL")
    left = c.where("lang IS NOT NULL AND structure IS NULL").select("lang", F.col("n").alias("a"))
    right = c.where("lang IS NULL AND structure IS NOT NULL").select("structure", F.col("n").alias("b"))
    j = cell.join(left, "lang").join(right, "structure")
    out = j.agg(F.sum(F.col("n") * F.col("n") / (F.col("a") * F.col("b"))).alias("s"), F.sum("n").alias("n"), F.least(F.count_distinct("lang"), F.count_distinct("structure")).alias("k"))
    out = out.withColumn("chi2", F.col("n") * (F.col("s") - 1))
    return out.select("chi2", F.when(F.col("k") > 1, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("n") * (F.col("k") - 1)))).alias("cramers_v"))


def top_k_dump(logits: DataFrame, k: int) -> DataFrame:
    """The k best tokens of an item, ties to the smaller id."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("logit").desc(), "token_id"))
    return logits.withColumn("place", place).where(F.col("place") <= k).select("item", F.col("place").cast("long").alias("place"), "token_id", "logit")


def kd_divergence(teacher: DataFrame, student: DataFrame, weights: DataFrame) -> DataFrame:
    """A10: weighted mean over items of KL(teacher, student). Both: ``item, token_id, p``; weights: ``item, weight``."""
    j = teacher.join(student.withColumnRenamed("p", "q"), ["item", "token_id"])
    kl = j.groupBy("item").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
    return kl.join(weights, "item").agg((F.sum(F.col("kl") * F.col("weight")) / F.sum("weight")).alias("kl"))


def _edits(a: Column, b: Column) -> Column:
    mine = F.transform(F.array(F.array_intersect(a, b)), lambda both: F.struct(*(F.array_join(F.transform(x, lambda w: _letter(both, w, k)), "").alias(n) for x, k, n in ((a, 0, "a"), (b, 1, "b")))))[0]
    return F.levenshtein(mine["a"], mine["b"]).cast("long")


def _letter(both: Column, word: Column, side: int) -> Column:
    at = F.array_position(both, word)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(at > 0, at + 0x10001).otherwise(0x10000 + side)), 8, "0")), "UTF-32")


def error_rates(pairs: DataFrame) -> DataFrame:
    """``id, ref, hyp`` with ``char_edits, cer, word_edits, wer``, whole texts, by code points and by words.

    Words become characters for the built-in edit distance: those of both
    texts by their number, all others match nothing and are one a side.
    """
    rows = pairs.select("id", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"))
    rows = rows.withColumns({"__r": X.words(F.col("ref")), "__h": X.words(F.col("hyp"))})
    rows = rows.withColumns({"char_edits": F.levenshtein("ref", "hyp").cast("long"), "word_edits": _edits(F.col("__r"), F.col("__h"))})
    rates = {"cer": (F.length("ref"), "char_edits"), "wer": (F.size("__r"), "word_edits")}
    return rows.withColumns({k: F.when(n > 0, F.col(d) / n) for k, (n, d) in rates.items()}).drop("__r", "__h")


def cer(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Character error rate of each of ``by``, mean of rows and over all characters."""
    by = by or []
    rows = pairs.where("length(ref) > 0").select(*by, F.length("ref").alias("n"), F.levenshtein("ref", F.coalesce("hyp", F.lit(""))).alias("d"))
    return rows.groupBy(*by).agg(F.avg(F.col("d") / F.col("n")).alias("macro"), (F.sum("d") / F.sum("n")).alias("micro"))


def wer(pairs: DataFrame) -> DataFrame:
    """Word error rate, mean of rows and over all words."""
    rows = error_rates(pairs).where("wer IS NOT NULL")
    return rows.agg(F.avg("wer").alias("macro"), (F.sum("word_edits") / F.sum(F.size(X.words(F.col("ref"))))).alias("micro"))


def minimal_pair_check(pairs: DataFrame) -> DataFrame:
    """By class, contrasting pairs ``a, b`` and how many are still distinct after a round trip (``a2, b2``)."""
    return pairs.where("a <> b").groupBy("contrast").agg(F.count("*").alias("pairs"), F.count_if(F.col("a2") != F.col("b2")).alias("distinct_after"))


def corpus_hours(rows: DataFrame, by: list[str], frames_per_second: float = 7_500.0) -> DataFrame:
    """Hours of audio by rollup, and days to see them once at a rate. rows: ``by`` and ``n_frames``."""
    return rows.rollup(*by).agg((F.sum("n_frames") / X.FPS / 3600).alias("hours"), (F.sum("n_frames") / frames_per_second / 86400).alias("days"))


def capture_quality_gate(recordings: DataFrame, samples: DataFrame, floor: float = 1e-4, rate: float = 24_000.0) -> DataFrame:
    """Empty, silent or ok, and seconds; recordings without samples appear too. Both by ``session``."""
    s = samples.groupBy("session").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"))
    j = recordings.select("session").distinct().join(s, "session", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") == 0, "empty").when(F.col("peak") < floor, "silent").otherwise("ok")
    return j.select("session", state.alias("state"), F.when(state == "ok", F.col("n") / rate).alias("seconds"))


def frame_balance(frames: DataFrame) -> DataFrame:
    """Speech, silence and transition frames, and inverse-frequency weights. Rows are frames, or runs of ``n`` frames, of which the first may be a transition."""
    runs = frames if "n" in frames.columns else frames.withColumn("n", F.lit(1).cast("long"))
    rows = scanned(runs, ["conv_id"], "frame_idx", ["frame_idx"], before=("prev", F.col("kind")))
    speech, before = F.col("kind") == "WORD", F.col("before")
    turn = before.isNotNull() & (speech != (before == "WORD"))
    one = lambda state, n: F.struct(state.alias("state"), n.cast("long").alias("n"))
    own = F.when(speech, "speech").otherwise("silence")
    parts = F.when(turn, F.array(one(F.lit("transition"), F.lit(1)), one(own, F.col("n") - 1))).otherwise(F.array(one(own, F.col("n"))))
    n = rows.select(F.explode(parts).alias("x")).select("x.*").where("n > 0").groupBy("state").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(F.lit(1))  # three rows
    return n.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def efficiency_curve(runs: DataFrame) -> DataFrame:
    """Slope and intercept of a metric against log(1 + hours), by task."""
    x = F.log1p("hours")
    return runs.groupBy("task").agg(F.regr_slope("metric", x).alias("slope"), F.regr_intercept("metric", x).alias("intercept"))


def ablation_report(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean metric by axis and arm, and the difference to the control arm."""
    by = runs.groupBy("axis", "arm").agg(F.avg("metric").alias("metric"))
    base = F.max(F.when(F.col("arm") == baseline, F.col("metric"))).over(Window.partitionBy("axis"))
    return by.withColumn("delta", F.col("metric") - base)


def voice_diversity(assigned: DataFrame) -> DataFrame:
    """Distinct voices, the top voice's share, and entropy in nats."""
    n = assigned.groupBy("voice").agg(F.count("*").alias("n"))
    t = n.agg(F.count("*").alias("voices"), F.max("n").alias("top"), F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nl"))
    return t.select("voices", (F.col("top") / F.col("all")).alias("top_share"), (F.log("all") - F.col("nl") / F.col("all")).alias("entropy"))


def gaps(segments: DataFrame) -> DataFrame:
    """Segments with ``gap``, the frames since the turn before ended (negative: overlap), and ``len``."""
    rows = scanned(segments, ["conv_id"], "turn", ["turn"], before=("prev", F.col("end_frame")))
    return rows.withColumn("gap", F.col("start_frame") - F.col("before")).withColumn("len", F.col("end_frame") - F.col("start_frame")).drop("before")


def turn_stats(segments: DataFrame) -> DataFrame:
    """By conversation: median response gap in frames, talk share of the assistant, share of overlapped turns, and of the user's turns those within one of the assistant's (backchannels)."""
    stats = gaps(segments).groupBy("conv_id").agg(
        F.median("gap").alias("median_gap"), (F.sum(F.when(F.col("role") == "assistant", F.col("len")).otherwise(0)) / F.sum("len")).alias("talk_share"), F.avg((F.col("gap") < 0).cast("double")).alias("overlap_share"),
        F.count_if(F.col("role") == "user").alias("n_user"),
    )
    return stats.join(backchannels(segments), "conv_id", "left").withColumn("backchannel_rate", F.when(F.col("n_user") > 0, F.coalesce("n_back", F.lit(0)) / F.col("n_user"))).drop("n_user", "n_back")


def backchannels(segments: DataFrame) -> DataFrame:
    return overlaps(segments).where("kind = 'backchannel'").groupBy("conv_id").agg(F.count_distinct("u_turn").alias("n_back"))


#: Parameter of the quantile sketches: their ranks are off by 1.33 % with 99 % confidence.
KLL = 200


def turn_levels(segments: DataFrame, langs: DataFrame) -> DataFrame:
    """A23 by conversation (``level`` conversation), by language and over the corpus: ``level, key, turns, median_gap, p90_gap, talk_share, overlap_share, backchannel_rate``. langs: ``conv_id, lang``.

    A conversation leaves sums and a KLL sketch of its gaps. Sums add up and
    sketches merge, so languages and the corpus are made of these, not of the
    turns again: the quantiles' ranks are off by some 1.3 % (see ``KLL``),
    however many conversations there are.
    """
    rows = gaps(segments).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.kll_sketch_agg_bigint(F.col("gap").cast("long"), F.lit(KLL)).alias("sketch"), F.count("gap").alias("n_gaps"), F.count_if(F.col("gap") < 0).alias("n_over"),
        F.sum(F.when(F.col("role") == "assistant", F.col("len")).otherwise(0)).alias("talk"), F.sum("len").alias("len"), F.count_if(F.col("role") == "user").alias("n_user"),
    )
    rows = written(rows.join(backchannels(segments), "conv_id", "left").join(langs, "conv_id", "left").withColumn("n_back", F.coalesce("n_back", F.lit(0))))
    sums = ["turns", "n_gaps", "n_over", "talk", "len", "n_user", "n_back"]
    upper = rows.rollup(F.lit(0).alias("corpus"), "lang").agg(*(F.sum(c).alias(c) for c in sums), F.kll_merge_agg_bigint("sketch", F.lit(KLL)).alias("sketch"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "language").otherwise("corpus")
    upper = upper.where("g < 2").select(level.alias("level"), F.col("lang").cast("string").alias("key"), *sums, "sketch")
    every = upper.unionByName(rows.select(F.lit("conversation").alias("level"), F.col("conv_id").cast("string").alias("key"), *sums, "sketch"))
    at = lambda q: F.when(F.col("n_gaps") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return every.select("level", "key", "turns", at(0.5).alias("median_gap"), at(0.9).alias("p90_gap"), share("talk", "len").alias("talk_share"), share("n_over", "n_gaps").alias("overlap_share"), share("n_back", "n_user").alias("backchannel_rate"))


#: Logarithm of the number of counters of a sketch of distinct values: the error is 1.6 % (one standard deviation).
HLL = 12


def voice_levels(assignments: DataFrame, by: str) -> DataFrame:
    """A22 at scale: distinct voices of each value of ``by`` and of all (``by`` null), estimated by HLL sketches that are merged upward: one pass, and a sketch of 4 kB a value, however many voices there are."""
    each = written(assignments.groupBy(by).agg(F.hll_sketch_agg("voice", F.lit(HLL)).alias("sketch"), F.count("voice").alias("n")))
    return each.rollup(by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("voices"), F.sum("n").alias("n"), F.grouping_id().alias("g")).select(by, (F.col("g") == 1).alias("every"), "voices", "n")


def segment_turns(events: DataFrame) -> DataFrame:
    """Runs of one speaker: ``session, run, role, first_id, last_id, n``."""
    along = (["session"], "event_id", ["event_id"])
    rows = scanned(events, *along, before=("prev", F.struct("role")))  # a struct: a null role isn't no row
    new = F.when(F.col("before").isNotNull() & F.col("before.role").eqNullSafe(F.col("role")), 0).otherwise(1)
    runs = scanned(rows, *along, run=("sum", new))
    return runs.groupBy("session", "run", "role").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


def checkpoint_regression(metrics: DataFrame, slack: float = 0.0) -> DataFrame:
    """Change of a metric against the checkpoint before and the best so far; worst first. metrics: ``metric, step, value``."""
    by = Window.partitionBy("metric").orderBy("step")
    best = F.max("value").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return metrics.select(
        "metric", "step", "value", (F.col("value") - F.lag("value").over(by)).alias("change"), (F.col("value") - best).alias("to_best"), F.coalesce(F.col("value") < best - slack, F.lit(False)).alias("dropped")
    ).orderBy(F.col("to_best").asc_nulls_last(), "metric", "step")
