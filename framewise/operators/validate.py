"""Constraint queries: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators.ranks import scanned


def check_epad(frames: DataFrame) -> DataFrame:
    """V1: EPAD not followed by a word. Two flags a frame are scanned, and nothing else of it."""
    kind = F.col("kind")
    flags = frames.select("conv_id", "frame_idx", kind.eqNullSafe("EPAD").alias("epad"), F.coalesce(~kind.isin("PAD", "EPAD"), F.lit(False)).alias("other"))
    rows = scanned(flags, ["conv_id"], "frame_idx", ["frame_idx"], after=("next", F.col("other")))
    return rows.where(F.col("epad") & ~F.coalesce("after", F.lit(False))).select("conv_id", "frame_idx")


def check_width(frames: DataFrame, k: int = X.CODEBOOKS, roles: int = 2) -> DataFrame:
    """V2: frames whose codes aren't ``roles * k`` wide. frames: ``conv_id, frame_idx, codes``."""
    if k < 1 or roles < 1:
        raise ValueError("k and roles must be 1 at least")
    return frames.where(F.coalesce(F.size("codes"), F.lit(0)) != roles * k).select("conv_id", "frame_idx", F.size("codes").cast("long").alias("width"))


def check_roles(rows: DataFrame, roles: int = 2) -> DataFrame:
    """V3: roles that are null or out of range; -1 isn't the last one."""
    return rows.where(F.col("role").isNull() | ~F.col("role").between(0, roles - 1))


def check_special_ids(tokens: DataFrame, banned: DataFrame, vocab: int) -> DataFrame:
    """V4: stream PAD ids that are within the vocabulary or are one of the banned ids. tokens: ``token_id``; banned: ``token_id, name``, a few rows."""
    return tokens.join(banned, "token_id", "left").where(F.col("name").isNotNull() | (F.col("token_id") < vocab)).select("token_id", F.coalesce("name", F.lit("in vocabulary")).alias("reason"))


def check_chunk(chunks: DataFrame, unit: int = X.FRAME_SAMPLES) -> DataFrame:
    """V5: chunks whose samples aren't a positive multiple of a frame. chunks: ``chunk_id, samples``."""
    bad = F.when(F.col("samples") < unit, "too short").when(F.col("samples") % unit != 0, "remainder lost")
    return chunks.withColumn("problem", bad).where("problem IS NOT NULL").select("chunk_id", "problem")


def check_sync(streams: DataFrame, n: int = 3) -> DataFrame:
    """V6: conversations that have not ``n`` streams, or whose streams differ in length or have gaps or repeats. streams: ``conv_id, stream, frame_idx``."""
    by = streams.groupBy("conv_id", "stream").agg(F.count("*").alias("n"), F.count_distinct("frame_idx").alias("d"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("span"))
    conv = by.groupBy("conv_id").agg(F.count("*").alias("streams"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.max((F.col("n") != F.col("d")).cast("int")).alias("repeats"), F.max((F.col("span") != F.col("d")).cast("int")).alias("gaps"))
    return conv.where((F.col("streams") != n) | F.expr("shortest <> longest OR repeats = 1 OR gaps = 1"))
