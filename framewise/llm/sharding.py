"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import materialize

SHARDS = 40
OVERHEAD = 16
SEED = 23


def rendezvous(keys: list[Column], weights: list[float], seed: int = SEED) -> Column:
    """The shard (0 to n - 1) with the highest score for a key.

    Score of a shard: -weight / ln(u), u the hash of key and shard in (0, 1).
    Keys alone decide; shard k gets rows in proportion to its weight, and a
    further shard takes rows from the others but moves none between them.
    """
    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), *keys), 12)  # 52 bits: with the half added, a double holds them, so u is never 0 or 1
        u = (bits.cast("double") + 0.5) / F.lit(float(2**52))
        return F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*(score(k, w) for k, w in enumerate(weights))))["shard"]


def shard(docs: DataFrame, weights: list[float] | None = None, grown: float = 1.0) -> DataFrame:
    """Put every row into a shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    docs: ``doc_id`` and ``text``; other columns are ignored. Law ``key``: the
    id and the weights decide (a null id is a key of its own), so equal texts
    with other ids may part and rows of one id share a shard. ``grown_shard``
    is the shard with one more, of weight ``grown``. size: UTF-8 bytes and
    ``OVERHEAD``; a null text has no bytes and the checksum 0. ``slot`` counts
    a shard's rows from 0 without gaps, by input split and then doc_id; rows of
    one id are split between slots by where they were read, so no key gathers
    in one task. No rows give no rows.
    """
    weights = [1.0] * SHARDS if weights is None else weights
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    key = [F.col("doc_id")]
    placed = materialize(
        docs.select(
            "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            rendezvous(key, weights).cast("int").alias("shard"), rendezvous(key, [*weights, grown]).cast("int").alias("grown_shard"), F.spark_partition_id().alias("split"),
        )
    )
    counts = placed.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "split", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "split").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("within", within)
        .join(starts, ["shard", "split"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
    )
