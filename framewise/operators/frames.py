"""Frame-aligned streams: placing words, padding, delays, roles and zones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators.ranks import BLOCK, numbered, scanned


def align_runs(words: DataFrame, horizon: DataFrame) -> DataFrame:
    """J1 in runs: ``conv_id, frame_idx, n, kind, word``: a word is a run of one frame, PAD before, between and after words a run of ``n``.

    Runs come from the words alone: each follows from its word and the one
    before, so no frame is shuffled, joined or sorted.
    """
    order = ["start_frame", "turn", "word_idx"]
    placed = numbered(words, ["conv_id"], F.floor(F.col("start_frame") / BLOCK), order, "i")
    moved = scanned(placed, ["conv_id"], "start_frame", order, ahead=("max", F.col("start_frame") - F.col("i"))).withColumn("at", F.col("i") + F.col("ahead"))
    moved = moved.select("conv_id", "i", "at", "word")
    ends = horizon.where("n_frames > 0").select(F.col("conv_id").alias("__conv"), "n_frames")
    moved = scanned(moved, ["conv_id"], "at", ["at"], before=("prev", F.col("at")))
    spoken = moved.join(ends, (F.col("conv_id") == F.col("__conv")) & (F.col("at") >= 0) & (F.col("at") < F.col("n_frames")))
    free = F.greatest(F.coalesce(F.col("before"), F.lit(-1).cast("long")), F.lit(-1).cast("long")) + 1
    run = lambda at, n, kind, word: F.struct(at.cast("long").alias("frame_idx"), n.cast("long").alias("n"), F.lit(kind).alias("kind"), word.alias("word"))
    none = F.lit(None).cast("string")
    each = spoken.select("conv_id", F.explode(F.array(run(free, F.col("at") - free, "PAD", none), run(F.col("at"), F.lit(1), "WORD", F.col("word")))).alias("x"))
    last = spoken.groupBy("__conv").agg(F.max("at").alias("last")).withColumnRenamed("__conv", "conv_id")
    start = F.coalesce(F.col("last"), F.lit(-1).cast("long")) + 1
    tail = ends.withColumnRenamed("__conv", "conv_id").join(last, "conv_id", "left").select("conv_id", run(start, F.col("n_frames") - start, "PAD", none).alias("x"))
    return each.unionByName(tail).select("conv_id", "x.*").where("n > 0").withColumn("kind", F.when(F.col("word").isNull(), "PAD").otherwise(F.col("kind")))


def expanded(runs: DataFrame) -> DataFrame:
    """``runs`` with a row for each of their ``n`` frames. Narrow: no shuffle."""
    return runs.withColumn("frame_idx", F.explode(F.sequence(F.col("frame_idx"), F.col("frame_idx") + F.col("n") - 1))).drop("n")


def cut_runs(runs: DataFrame, at: list[int]) -> DataFrame:
    """``runs`` parted at the frames ``at``, so that none goes across one of them."""
    edges = F.array_sort(F.concat(F.array("frame_idx", F.col("frame_idx") + F.col("n")), F.filter(F.array(*(F.lit(a).cast("long") for a in at)), lambda a: (a > F.col("frame_idx")) & (a < F.col("frame_idx") + F.col("n")))))
    part = F.transform(F.sequence(F.lit(1), F.size("__e") - 1), lambda i: F.struct(F.get("__e", i - 1).alias("frame_idx"), (F.get("__e", i) - F.get("__e", i - 1)).alias("n")))
    rows = runs.withColumn("__e", edges).withColumn("__x", F.explode(part))
    return rows.select(*(F.col(f"__x.{c}").alias(c) if c in ("frame_idx", "n") else F.col(c) for c in runs.columns))


def align_words(words: DataFrame, horizon: DataFrame) -> DataFrame:
    """A spine of frames with each word on its start frame, later ones moved on to the next free frame.

    words: ``conv_id, word, start_frame`` and an order ``turn, word_idx``;
    horizon: ``conv_id, n_frames``. Frames without a word are PAD.
    """
    return expanded(align_runs(words, horizon)).select("conv_id", "frame_idx", "kind", "word")


def mark_epad(frames: DataFrame) -> DataFrame:
    """PAD right before a word becomes EPAD. Rows are frames, or runs of ``n`` frames: the last of a run of PAD is parted from it."""
    rows = scanned(frames, ["conv_id"], "frame_idx", ["frame_idx"], __after=("next", F.col("kind").eqNullSafe("WORD")))
    marked = (F.col("kind") == "PAD") & F.coalesce("__after", F.lit(False))
    if "n" not in frames.columns:
        return rows.withColumn("kind", F.when(marked, "EPAD").otherwise(F.col("kind"))).drop("__after")
    run = lambda at, n, kind: F.struct(at.alias("frame_idx"), n.alias("n"), kind.alias("kind"))
    last = F.col("n") - 1
    parts = F.when(marked, F.array(run(F.col("frame_idx"), last, F.col("kind")), run(F.col("frame_idx") + last, F.lit(1).cast("long"), F.lit("EPAD")))).otherwise(F.array(run(F.col("frame_idx"), F.col("n"), F.col("kind"))))
    return rows.withColumn("__x", F.explode(parts)).select(*(F.col(f"__x.{c}").alias(c) if c in ("frame_idx", "n", "kind") else F.col(c) for c in frames.columns)).where("n > 0")


def interleave_pad(tokens: DataFrame, ratio: float, seed: int) -> DataFrame:
    """A geometric run of PAD, the last of them EPAD, before each token. tokens: ``conv_id, pos, token``; 0 <= ratio < 1."""
    return interleave_pads(tokens, [ratio], seed).drop("ratio")


def interleave_pads(tokens: DataFrame, ratios: list[float], seed: int) -> DataFrame:
    """W5 for several ratios in one pass: a stream for each ``ratio`` and conversation."""
    if not all(0 <= ratio < 1 for ratio in ratios):
        raise ValueError("ratio must be in [0, 1): a run would never end")
    u = X.uniform(F.concat_ws(":", "conv_id", "pos", F.lit(seed)))
    ratios = list(map(float, ratios))
    n = [F.floor(F.log(u) / F.log(F.lit(ratio))).cast("int") if ratio > 0 else F.lit(0) for ratio in ratios]
    # One scan over the tokens, with a sum for each ratio: a row a ratio only comes after it.
    runs = tokens.withColumns({f"__n{i}": c for i, c in enumerate(n)})
    runs = scanned(runs, ["conv_id"], "pos", ["pos"], **{f"__end{i}": ("sum", F.col(f"__n{i}") + 1) for i in range(len(ratios))})
    one = lambda i: F.struct(F.lit(ratios[i]).alias("ratio"), F.col(f"__n{i}").alias("n"), (F.col(f"__end{i}") - F.col(f"__n{i}") - 1).alias("first"))
    runs = runs.select("conv_id", "token", F.explode(F.array(*map(one, range(len(ratios))))).alias("x")).select("conv_id", "token", "x.*")
    each = runs.select("ratio", "conv_id", "first", "n", "token", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    kind = F.when(F.col("k") == F.col("n"), "WORD").when(F.col("k") == F.col("n") - 1, "EPAD").otherwise("PAD")
    return each.select("ratio", "conv_id", (F.col("first") + F.col("k")).alias("frame_idx"), kind.alias("kind"), F.when(F.col("k") == F.col("n"), F.col("token")).alias("token"))


def decode_stream(frames: DataFrame) -> DataFrame:
    """the words of each conversation in order, and the first and last frame that has one."""
    spoken = frames.where("kind = 'WORD'")
    return spoken.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
    )


def delay_pattern(codes: DataFrame, tau: int) -> DataFrame:
    """Codebooks from 1 on, of each role, come ``tau`` frames later; the head is filled with the placeholder, what passes the end is kept."""
    slot = F.col("codebook") % X.CODEBOOKS
    moved = codes.withColumn("frame_idx", F.col("frame_idx") + F.when(slot > 0, tau).otherwise(0))
    head = codes.where((F.col("frame_idx") < tau) & (slot > 0)).withColumn("code", F.lit(X.PLACEHOLDER).cast("long"))
    return moved.unionByName(head)


def undelay(codes: DataFrame, tau: int) -> DataFrame:
    """W3 inverse: drop the head and move codebooks back."""
    slot = F.col("codebook") % X.CODEBOOKS
    return codes.where((slot == 0) | (F.col("frame_idx") >= tau)).withColumn("frame_idx", F.col("frame_idx") - F.when(slot > 0, tau).otherwise(0))


def text_shift(seconds: float) -> int:
    """Frames that a text delay moves by: halves away from zero."""
    return int(math.copysign(math.floor(abs(seconds) * X.FPS + 0.5), seconds))


def delay_text(frames: DataFrame, codes: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    """(frames, codes) with text ``seconds`` after the audio (ASR layout) or, if negative, before it (TTS layout); 0 is dialogue.

    The later stream moves and its head is filled: text with PAD, codes with
    the placeholder. What passes the end is kept. frames: ``conv_id, frame_idx,
    kind, word``; codes: ``conv_id, frame_idx, codebook, code``.
    """
    d = text_shift(seconds)
    if d >= 0:
        head = frames.where(F.col("frame_idx") < d).withColumns({"kind": F.lit("PAD"), "word": F.lit(None).cast("string")})
        return frames.withColumn("frame_idx", F.col("frame_idx") + d).unionByName(head), codes
    head = codes.where(F.col("frame_idx") < -d).withColumn("code", F.lit(X.PLACEHOLDER).cast("long"))
    return frames, codes.withColumn("frame_idx", F.col("frame_idx") - d).unionByName(head)


def undelay_text(frames: DataFrame, codes: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    """W3 inverse: drop the head of the later stream and move it back."""
    d = text_shift(seconds)
    back = lambda s, n: s.where(F.col("frame_idx") >= n).withColumn("frame_idx", F.col("frame_idx") - n)
    return back(frames, max(0, d)), back(codes, max(0, -d))


def complete_prefix(codes: DataFrame) -> DataFrame:
    """Frames before the first that holds a placeholder are ready, the rest wait: one frame a conversation decides, so nothing is sorted."""
    first = codes.where(F.col("code") == X.PLACEHOLDER).groupBy("conv_id").agg(F.min("frame_idx").alias("__open"))
    return codes.select("conv_id", "frame_idx").distinct().join(first, "conv_id", "left").select("conv_id", "frame_idx", F.coalesce(F.col("frame_idx") < F.col("__open"), F.lit(True)).alias("ready"))


def split_roles(frames: DataFrame, k: int = X.CODEBOOKS) -> DataFrame:
    """A frame of 2k codes becomes a row a role: k - 1 inputs and k labels. Narrow: no shuffle."""
    one = lambda r: F.struct(F.lit(r).alias("role"), F.slice("codes", r * k + 1, k - 1).alias("inputs"), F.slice("codes", r * k + 1, k).alias("labels"))
    return frames.select("conv_id", "frame_idx", F.explode(F.array(one(0), one(1))).alias("x")).select("conv_id", "frame_idx", "x.*")


def merge_roles(rows: DataFrame) -> DataFrame:
    """R2: both roles' labels of a frame, end to end."""
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("labels")))
    return rows.groupBy("conv_id", "frame_idx").agg(F.concat(side(0), side(1)).alias("codes"))


def render_prompt(conv: DataFrame, condition: str) -> DataFrame:
    """A conversation as one prompt: ``chatml`` markers closed, ``open`` for the last turn, ``open_pad`` with PAD after it, ``no_markers``. A system turn is always closed."""
    end = F.max("turn").over(Window.partitionBy("conv_id"))
    block = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"))
    closed = F.concat(block, F.lit("<|im_end|>\n"))
    if condition == "no_markers":
        line = F.when(F.col("role") == "system", closed).otherwise(F.concat(F.col("text"), F.lit("\n")))
    elif condition == "chatml":
        line = closed
    else:
        tail = F.concat(block, F.lit(" <pad>" if condition == "open_pad" else ""))
        line = F.when((F.col("turn") == F.col("last")) & (F.col("role") != "system"), tail).otherwise(closed)
    rows = conv.withColumn("last", end).select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "").alias("prompt"))


def assemble_zones(conv: DataFrame, voice_frames: int) -> DataFrame:
    """The three zones of a session: ``conv_id, zone, text, n_tokens, start``.

    A: system turns as ChatML blocks, then an assistant block that stays open.
    B: the voice prompt, ``voice_frames`` long: the transcript of its opening
    line (the first assistant turn), a word a frame, then PAD; a longer line
    keeps all its words. C: the other turns without markers, then the end token, which is
    nowhere else. Null texts are left out. Tokens are counted by white space.
    """
    turn, system = F.struct("turn", "text"), F.col("role") == "system"
    of = lambda kept: F.sort_array(F.collect_list(F.when(kept & F.col("text").isNotNull(), turn)))
    opens = F.min(F.when(F.col("role") == "assistant", turn)).alias("opens")
    one = conv.groupBy("conv_id").agg(of(system).alias("a"), opens, of(~system).alias("c"))
    block = lambda x: F.concat(F.lit("<|im_start|>system\n"), x["text"], F.lit("<|im_end|>\n"))
    a = F.concat(F.array_join(F.transform("a", block), ""), F.lit("<|im_start|>assistant\n"))
    line = X.words(F.coalesce("opens.text", F.lit("")))
    b = F.array_join(F.concat(line, F.array_repeat(F.lit("PAD"), F.greatest(F.lit(0), voice_frames - F.size(line)))), " ")
    rest = F.transform(F.filter("c", lambda x: ~x["turn"].eqNullSafe(F.col("opens.turn"))), lambda x: x["text"])
    c = F.array_join(F.concat(rest, F.array(F.lit("<|im_end|>"))), " ")
    zones = one.select("conv_id", F.array(a, b, c).alias("texts")).withColumn("n", F.transform("texts", lambda t: F.size(X.words(t)).cast("long")))
    each = zones.select("conv_id", F.posexplode("texts").alias("k", "text"), "n")
    start = F.aggregate(F.slice("n", 1, F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x)
    return each.select("conv_id", F.substring(F.lit("ABC"), F.col("k") + 1, 1).alias("zone"), "text", F.element_at("n", F.col("k") + 1).alias("n_tokens"), start.alias("start"))


def persona_prefix(conv: DataFrame, voice_frames: int, silence: int = 6) -> DataFrame:
    """A prefix of four parts, voice, silence, text, silence, with its three streams aligned by frame.

    ``text`` has a token a frame in the text part (the persona between
    ``<system>`` tags) and PAD elsewhere; ``assistant`` has the voice sample's
    frames in the voice part (``voice:0`` on) and silence elsewhere; ``user``
    is the sine constant throughout.
    """
    tag = F.array(F.lit("<system>"))
    row = lambda part, text, assistant: F.struct(F.lit(part).alias("part"), text.alias("text"), assistant.alias("assistant"))
    pad, quiet = F.lit("PAD"), F.lit("silence")
    parts = F.concat(
        F.array(*(row("voice", pad, F.lit(f"voice:{i}")) for i in range(voice_frames))),
        F.array_repeat(row("silence", pad, quiet), silence),
        F.transform(F.concat(tag, X.words(F.col("text")), tag), lambda w: row("text", w, quiet)),
        F.array_repeat(row("silence", pad, quiet), silence),
    )
    return conv.where("role = 'system'").select("conv_id", F.posexplode(parts).alias("frame_idx", "x")).select("conv_id", "frame_idx", "x.*", F.lit("sine").alias("user"))


def pad_to_frames(lengths: DataFrame) -> DataFrame:
    """Text padded right to its frames; a text that is longer is an error row. lengths: ``conv_id, n_tokens, n_frames``."""
    fits = F.col("n_tokens") <= F.col("n_frames")
    return lengths.select("conv_id", F.when(fits, F.col("n_frames") - F.col("n_tokens")).alias("n_pad"), F.when(~fits, "text longer than frames").alias("error"))


def extend_user_stream(user: DataFrame, horizon: DataFrame) -> DataFrame:
    """User frames over the whole horizon; ``supplied`` tells real ones from silence filled in."""
    spine = horizon.where("n_frames > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame_idx"))
    return spine.join(user.select("conv_id", "frame_idx", F.lit(True).alias("s")).distinct(), ["conv_id", "frame_idx"], "left").select("conv_id", "frame_idx", F.coalesce("s", F.lit(False)).alias("supplied"))


def drop_prompt(frames: DataFrame, n: int) -> DataFrame:
    """Frames after the prompt's ``n``, counted from 0 again."""
    return frames.where(F.col("frame_idx") >= n).withColumn("frame_idx", F.col("frame_idx") - n)


def loss_weights(frames: DataFrame, pad: float = 0.3, transition: float = 2.0) -> DataFrame:
    """Zone A 0, stream PAD ``pad``, else 1; where speech begins or ends, times ``transition``. frames: ``conv_id, frame_idx, kind, zone``.

    Rows are frames, or runs of ``n`` frames: the first of a run is parted from it where it weighs otherwise.
    """
    speech = lambda c: F.col(c) == "WORD"
    turn = speech("kind") != F.coalesce(speech("__before"), speech("kind"))
    base = F.when(F.col("zone") == "A", 0.0).when(F.col("kind") == "PAD", pad).otherwise(1.0)
    rows = scanned(frames, ["conv_id"], "frame_idx", ["frame_idx"], __before=("prev", F.col("kind")))
    first = base * F.when(turn, transition).otherwise(1.0)
    if "n" not in frames.columns:
        return rows.withColumn("weight", first).drop("__before")
    run = lambda at, n, weight: F.struct(at.alias("frame_idx"), n.alias("n"), weight.alias("weight"))
    at, n = F.col("frame_idx"), F.col("n")
    parts = F.when(turn, F.array(run(at, F.lit(1).cast("long"), first), run(at + 1, n - 1, base))).otherwise(F.array(run(at, n, base)))
    return rows.withColumn("__x", F.explode(parts)).select(*(F.col(f"__x.{c}").alias(c) if c in ("frame_idx", "n") else F.col(c) for c in frames.columns), F.col("__x.weight").alias("weight")).where("n > 0")


def audio_weights(codes: DataFrame, acoustic: float = 0.02) -> DataFrame:
    """Codes that aren't semantic weigh ``acoustic``, placeholders nothing."""
    slot = F.col("codebook") % X.CODEBOOKS
    return codes.withColumn("weight", F.when(F.col("code") == X.PLACEHOLDER, 0.0).when(slot > 0, acoustic).otherwise(1.0))


def chunk_frames(counts: DataFrame, n: int) -> DataFrame:
    """Whole chunks of ``n`` frames and the frames left over. counts: ``session, n_frames``."""
    return counts.select("session", F.floor(F.col("n_frames") / n).alias("chunks"), (F.col("n_frames") % n).alias("left_over"))


def training_windows(frames: DataFrame, size: int = 750, context: int = 3000) -> DataFrame:
    """Windows of ``size`` frames; ``whole`` marks full ones, ``beyond`` frames that only a long context would see."""
    return (
        frames.groupBy("conv_id", F.floor(F.col("frame_idx") / size).alias("window"))
        .agg(F.count("*").alias("n_frames"), F.count_if(F.col("frame_idx") >= context).alias("beyond"))
        .withColumn("whole", F.col("n_frames") == size)
    )
