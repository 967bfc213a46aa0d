"""Tables, sinks and the views that the other operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators.ranks import numbered, scanned, written


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Spark prunes columns and pushes filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_frames(df: DataFrame, path: str, by: str = "lang") -> DataFrame:
    """Write prepared rows, one folder a value of ``by``; rewriting replaces only the folders it has rows for. Returns the table read back."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def manifest_prune(manifest: DataFrame, json: str, shard: str, pattern: str) -> DataFrame:
    """The distinct shards whose JSON map has a key and value that fit ``pattern``."""
    entry = F.explode(F.from_json(json, "map<string,string>")).alias("key", "value")
    return manifest.select(shard, entry).where(F.concat_ws("=", "key", "value").rlike(pattern)).select(shard).distinct().orderBy(shard)


def words_view(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, word_idx, word, start_frame, n_frames`` of spoken turns."""
    each = X.words(F.col("text"))
    frames = lambda w: 2 + F.floor(F.length(w) / 4)
    turns = conversations.where("role <> 'system'").select("conv_id", "turn", "role", each.alias("ws"))
    turns = turns.withColumn("len", F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + frames(w)))
    turns = written(turns)  # so that texts are split once
    gap = X.hash32(F.concat_ws(":", "conv_id", "turn")) % 11 - 4  # before each turn but a conversation's first
    turns = scanned(turns, ["conv_id"], "turn", ["turn"], end=("sum", gap + F.col("len")), none=("first", gap))
    turns = turns.withColumn("turn_start", F.col("end") - F.col("none") - F.col("len"))
    placed = turns.select("conv_id", "turn", "role", "turn_start", F.posexplode("ws").alias("word_idx", "word")).withColumn("n_frames", frames(F.col("word")).cast("long"))
    before = F.sum("n_frames").over(Window.partitionBy("conv_id", "turn").orderBy("word_idx")) - F.col("n_frames")
    return placed.select("conv_id", "turn", "role", F.col("word_idx").cast("long").alias("word_idx"), "word", (F.col("turn_start") + before).alias("start_frame"), "n_frames")


def segments_view(words: DataFrame) -> DataFrame:
    """First and last frame (exclusive) of every turn."""
    return words.groupBy("conv_id", "turn", "role").agg(F.min("start_frame").alias("start_frame"), F.max(F.col("start_frame") + F.col("n_frames")).alias("end_frame"))


def code_frames_view(embeddings: DataFrame, codebooks: int = 16) -> DataFrame:
    """``conv_id, frame_idx, codes`` made from vectors: conversation = label, frame = rank of the vector."""
    each = F.transform(F.slice("embedding", 1, codebooks), lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 2048)
    rows = embeddings.select(F.col("label").alias("conv_id"), "vec_id", each.alias("codes"))
    return numbered(rows, ["conv_id"], F.floor(F.col("vec_id") / 2**16), ["vec_id"], "frame_idx").select("conv_id", "frame_idx", "codes")


def codes_view(embeddings: DataFrame, codebooks: int = 16) -> DataFrame:
    """``conv_id, frame_idx, codebook, code``: the same, a row a code."""
    rows = code_frames_view(embeddings, codebooks).select("conv_id", "frame_idx", F.posexplode("codes").alias("codebook", "code"))
    return rows.withColumn("codebook", F.col("codebook").cast("long"))


def logits_view(embeddings: DataFrame) -> DataFrame:
    """``item, token_id, logit, target`` made from vectors; the target is 6 times the label."""
    return embeddings.select(F.col("vec_id").alias("item"), (F.col("label") * 6).cast("long").alias("target"), F.posexplode("embedding").alias("token_id", "x")).select("item", F.col("token_id").cast("long").alias("token_id"), F.col("x").cast("double").alias("logit"), "target")


def generations_view(documents: DataFrame) -> DataFrame:
    """``probe, condition, seed, text``: documents as outputs of a model, one in 17 blank."""
    condition = F.element_at(F.array(*map(F.lit, ("chatml", "open", "open_pad", "no_markers"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents.select(F.col("lang").alias("probe"), condition.alias("condition"), (F.col("doc_id") % 3).alias("seed"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.col("text")).alias("text"))


def signal_view(events: DataFrame) -> DataFrame:
    """``session, role, event_id, micros, value``: events as samples of two speakers."""
    role = F.when(F.col("event_type").isin("click", "view", "purchase"), "assistant").otherwise("user")
    return events.select(F.col("user_id").alias("session"), role.alias("role"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "value")
