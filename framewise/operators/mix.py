"""Corpus curation: pairs, ramps, budgets, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.operators.ranks import by_hash, hash_bits, scanned


def single_turn_pairs(conv: DataFrame) -> DataFrame:
    """Adjacent user and assistant turns: ``conv_id, turn, prompt, reply``."""
    rows = scanned(conv.select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", ["turn"], after=("next", F.struct("role", "text")))
    return rows.where("role = 'user' AND after.role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("after.text").alias("reply"))


def two_direction(pairs: DataFrame) -> DataFrame:
    """Each pair as a TTS row and an ASR row; one scan."""
    one = lambda d, a, b: F.struct(F.lit(d).alias("direction"), F.col(a).alias("source"), F.col(b).alias("target"))
    return pairs.select("conv_id", "turn", F.explode(F.array(one("tts", "prompt", "reply"), one("asr", "reply", "prompt"))).alias("x")).select("conv_id", "turn", "x.*")


def classify_unit(conv: DataFrame) -> DataFrame:
    """Isolated utterance, single-turn pair or multi-turn."""
    by = conv.where("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))
    return by.select("conv_id", F.when(F.col("n") == 1, "isolated").when((F.col("n") == 2) & (F.col("roles") == 2), "single_turn").otherwise("multi_turn").alias("structure"))


def quality_filter(samples: DataFrame, max_error: float) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): real audio always, synthetic up to the error rate; each row is in one of the two (an unknown error drops a synthetic one)."""
    fits = F.coalesce((~F.col("synthetic")) | (F.col("error") <= max_error), F.lit(False))
    return samples.where(fits), samples.where(~fits)


def filters_agree(samples: DataFrame, filters: dict[str, DataFrame]) -> DataFrame:
    """Distinct ``samples`` with a ``verdict``: kept_by_all of ``filters`` (kept rows, by name; INTERSECT), or dropped_by the only one that drops them (EXCEPT)."""
    kept = None
    for rows in filters.values():
        kept = rows if kept is None else kept.intersect(rows)
    out = kept.withColumn("verdict", F.lit("kept_by_all"))
    for name, rows in filters.items():
        others = None
        for other, r in filters.items():
            if other != name:
                others = r if others is None else others.intersect(r)
        alone = (samples.distinct() if others is None else others).exceptAll(rows.distinct())
        out = out.unionByName(alone.withColumn("verdict", F.lit(f"dropped_by_{name}")))
    return out


def language_ramp(corpus: DataFrame, target: str, stages: list[float]) -> DataFrame:
    """Members of each stage: all other languages, and so much of ``target`` that it is a share of the stage.

    A document's place in the target language is its hash; the threshold comes
    from group counts, so a document once in stays in as shares rise.
    """
    n = corpus.agg(F.count_if(F.col("lang") == target).alias("t"), F.count_if(F.col("lang") != target).alias("o")).first()
    u = X.uniform(F.col("doc_id").cast("string"))
    limit = lambda s: min(1.0, n["o"] * s / (1 - s) / n["t"]) if n["t"] else 0.0
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), F.lit(limit(s)).alias("limit")) for i, s in enumerate(stages)))).alias("x")
    rows = corpus.select("doc_id", "lang", u.alias("u"), each).select("doc_id", "lang", "u", "x.*")
    return rows.where((F.col("lang") != target) | (F.col("u") < F.col("limit"))).select("stage", "doc_id", "lang")


def mixture_plan(items: DataFrame, batches: int, floor: float) -> DataFrame:
    """Deal each task's items evenly over batches in hash order; a batch's anchor share, and whether it is below the floor. items: ``item_id, task``."""
    dealt = by_hash(items, ["task"], "item_id").withColumn("batch", F.col("place") % batches)
    by = dealt.groupBy("batch").agg(F.count("*").alias("n"), F.avg((F.col("task") == "anchor").cast("double")).alias("anchor_share"))
    return by.select(F.col("batch").cast("long").alias("batch"), "n", "anchor_share", (F.col("anchor_share") < floor).alias("below_floor"))


def hour_budget(corpus: DataFrame, budgets: list[float]) -> DataFrame:
    """Nested subsets by running hours in hash order: a row a document and budget it is in.

    Two levels, so no task sorts the corpus: sums of the hash's buckets first,
    as many as the rows ask for, then a running sum within each. corpus:
    ``doc_id, hours``.
    """
    h = X.hash32(F.col("doc_id").cast("string"))
    rows = corpus.withColumn("h", h).withColumn("bucket", F.floor(F.col("h") / 2 ** (32 - hash_bits(corpus.count()))))
    sums = rows.groupBy("bucket").agg(F.sum("hours").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a bucket
    start = sums.select("bucket", before.alias("before"))
    run = F.sum("hours").over(Window.partitionBy("bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("run", run).join(start, "bucket").withColumn("until", F.col("before") + F.col("run"))
    each = at.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return each.where("round(until, 6) <= budget").select("budget", "doc_id")


def synthesis_requests(pairs: DataFrame, voices: DataFrame) -> DataFrame:
    """Text pairs joined with their voices as one request table with stable ids. voices: ``sample_id, voice``."""
    key = F.concat_ws(":", "conv_id", "turn")
    j = pairs.withColumn("sample_id", key).join(voices, "sample_id")
    return j.select(F.sha2(F.concat_ws("|", "sample_id", "voice"), 256).alias("request_id"), "sample_id", "voice", F.length("reply").cast("long").alias("n_chars"))
