"""Vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.joins import within_intervals
from framewise.session import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def interpolate(pairs: DataFrame, weights: list[float]) -> DataFrame:
    """w * a + (1 - w) * b on a grid of weights. pairs: ``a_id, b_id, a, b``."""
    each = pairs.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    return each.select("a_id", "b_id", "w", F.zip_with("a", "b", lambda x, y: F.col("w") * x.cast("double") + (1 - F.col("w")) * y.cast("double")).alias("v"))


def table_compare(pairs: DataFrame, by: str = "codebook") -> DataFrame:
    """By codebook: mean row cosine, and the share of the difference's energy that a constant offset explains. pairs: ``codebook, a, b``."""
    cos = pairs.groupBy(by).agg(F.avg(cosine(F.col("a"), F.col("b"))).alias("mean_cosine"))
    d = pairs.select(by, F.posexplode(F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))).alias("pos", "d"))
    each = d.groupBy(by, "pos").agg(F.avg("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("e"), F.count("*").alias("n"))
    share = each.groupBy(by).agg((F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("e")).alias("offset_share"))
    return cos.join(share, by).select(by, "mean_cosine", "offset_share", (1 - F.col("offset_share")).alias("residual_share"))


def embedding_drift(pairs: DataFrame) -> DataFrame:
    """L2 and cosine distance of each row from its start. pairs: ``row_id, a, b``."""
    diff = F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))
    return pairs.select("row_id", F.sqrt(dot(diff, diff)).alias("l2"), (1 - cosine(F.col("a"), F.col("b"))).alias("cosine_distance"))


def centroid(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Element-wise mean: ``by, pos, value`` in long form, so no vector list is gathered."""
    return vectors.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def voice_drift_guard(frames: DataFrame, spans: DataFrame, threshold: float) -> DataFrame:
    """Mean similarity by step over the frames that lie in overlaps; stop below the threshold or when the gain is gone.

    frames: ``conv_id, frame_idx, step, similarity``; spans: rows of J4.
    """
    return drift_steps(within_intervals(frames, spans), threshold)


#: Conversations of a block: each block meets the samples of its key in a task of its own.
BLOCK = 512


def sampled_within(samples: DataFrame, conversations: DataFrame, spans: DataFrame, frame: Column, horizon: int) -> DataFrame:
    """``step, similarity``: each sample measured at ``frame`` of each conversation of its ``k``; only frames within ``spans`` are kept.

    samples: ``row_id, k, step, similarity``; conversations: ``conv_id, k``;
    ``frame``: of ``row_id`` and ``conv_id``, 0 to ``horizon`` - 1. The pairs are
    as many as the samples times the conversations, so they are tested where
    they arise: a conversation carries a flag a frame along, one without spans
    is left out, and no pair is shuffled. Blocks of conversations spread a
    ``k`` over tasks.
    """
    at = spans.where(F.col("start_frame") < horizon).groupBy("conv_id").agg(F.collect_list(F.struct("start_frame", "end_frame")).alias("spans"))
    inside = lambda f: F.exists("spans", lambda s: (s["start_frame"] <= f) & (f < s["end_frame"]))
    held = conversations.join(at, "conv_id").withColumn("inside", F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), inside))
    held = written(held.select("conv_id", "k", "inside"))
    most, keys = held.groupBy("k").count().agg(F.max("count"), F.count("*")).first()
    blocks = max(1, -(-(most or 0) // BLOCK))
    tasks = max(1, 4 * blocks * keys)  # named, as few bytes make many pairs
    held = held.withColumn("block", F.pmod(F.xxhash64("conv_id"), F.lit(blocks)).cast("int"))
    each = samples.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.repartition(tasks, "k", "block").join(held.repartition(tasks, "k", "block"), ["k", "block"]).where(F.get("inside", frame)).select("step", "similarity")


def drift_steps(frames: DataFrame, threshold: float) -> DataFrame:
    """The second half of A14, over frames that lie in overlaps."""
    by = frames.groupBy("step").agg(F.avg("similarity").alias("similarity"))
    gain = F.col("similarity") - F.lag("similarity").over(Window.orderBy("step"))  # a row a step
    return by.withColumn("gain", gain).withColumn("stop", (F.col("similarity") < threshold) | F.coalesce(F.col("gain") <= 0, F.lit(False)))
