"""Token counts for every context limit from one exact length histogram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import buffers, small_batches
from framewise.llm.tokenizing import encoder


def lengths(docs: DataFrame, tokenizer: str, by: list[str]) -> DataFrame:
    """``by`` and ``n_tokens``, the number of ids of each whole text; null is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(*by, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("__text"))
    made = T.StructType([*(rows.schema[c] for c in by), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            _, at = enc.encode(*buffers(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(np.diff(at), pa.int64())], names=made.names)

    return rows.mapInArrow(count, made)


def histogram(docs: DataFrame, tokenizer: str, by: str = "lang") -> DataFrame:
    """Exact length histogram of each value of ``by`` (null is a value), with its sums.

    Returns a row per value and length: ``by``, ``n_tokens``, ``n_docs`` (of
    that length), ``docs_from`` and ``tokens_from`` (suffix sums: documents at
    least so long and their tokens), ``share_within`` (of documents, this long
    at most) and ``tokens_within`` (tokens left if every text is cut to
    ``n_tokens``). ``totals`` and ``quantiles`` read any limit from it. Its size
    is bounded by the number of distinct lengths, whatever the corpus. Repeated
    rows count each; no rows give no rows.
    """
    counts = lengths(docs, tokenizer, [by]).groupBy(by, "n_tokens").agg(F.count("*").alias("n_docs"))
    suffix = Window.partitionBy(by).orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(by)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        counts.withColumn("docs_from", F.sum("n_docs").over(suffix))
        .withColumn("tokens_from", F.sum(tokens).over(suffix))
        .withColumn("share_within", 1 - (F.col("docs_from") - F.col("n_docs")) / F.sum("n_docs").over(every))
        .withColumn("tokens_within", F.sum(tokens).over(every) - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"))
    )


def totals(hist: DataFrame, limits: list[int], by: str = "lang") -> DataFrame:
    """``by``, ``context``, ``tokens`` and ``kept``: all tokens, and those left when texts are cut at each limit.

    Read from the suffix sums at the least length beyond a limit: texts from
    there on keep the limit, the tokens of all others stay.
    """
    each = hist.withColumn("context", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))))
    beyond = F.when(F.col("n_tokens") > F.col("context"), F.col("n_tokens"))
    cut = F.min_by(F.struct("tokens_from", "docs_from"), beyond)
    sums = each.groupBy(by, "context").agg(F.max("tokens_from").alias("tokens"), F.when(F.min(beyond).isNotNull(), cut).alias("cut"))
    return sums.select(by, "context", "tokens", (F.col("tokens") - F.coalesce(F.col("cut.tokens_from"), F.lit(0)) + F.col("context") * F.coalesce(F.col("cut.docs_from"), F.lit(0))).alias("kept"))


def quantiles(hist: DataFrame, shares: list[float], by: str = "lang") -> DataFrame:
    """``by``, ``share`` and ``n_tokens``: the least length that this share of documents doesn't exceed."""
    each = hist.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return each.where("share_within >= share").groupBy(by, "share").agg(F.min("n_tokens").alias("n_tokens"))
