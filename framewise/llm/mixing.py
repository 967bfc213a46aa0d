"""Mixing sources to target weights by Sainte-Lague apportionment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import materialize, plain_names

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 11
#: Words of a source, more or less, in one of its shards; more where shards would be over SHARDS.
SHARD_WORDS = 1 << 20
SHARDS = 1 << 16
#: Copies of one row that a task writes out at most.
COPIES = 1 << 16
SIZE = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. A target stops at ``most`` times its source's size
    and the excess is shared again by weight until none is above.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))  # one row a source
    ranked = materialize(sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1).cast("double")).withColumn("rank", place))
    cap = F.col("source_size") * most
    level = math.inf
    while True:
        full = F.lit(False) if level == math.inf else F.col("w") * level >= cap
        r = ranked.agg(F.sum("source_size").alias("s"), F.sum(F.when(full, cap).otherwise(0)).alias("c"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not r["s"] or not r["w"]:
            level = math.inf if r["s"] else 0.0
            break
        new = (share * r["s"] - r["c"]) / r["w"]
        if new == level or (level != math.inf and new <= level):
            break
        level = new
    target = cap.cast("double") if level == math.inf else F.least(F.col("w") * level, cap.cast("double"))
    return ranked.withColumn("target", target)


def apportion(cells: DataFrame, blocks: int) -> DataFrame:
    """``cells`` (``cell``, ``votes``) with ``quota``: ``blocks`` given to the highest quotients votes / (2 s + 1).

    Sainte-Lague without one step a block: rounding votes / (all votes / blocks)
    is off by half a block a cell at most, so only quotients near each cell's
    share compete. Ties go to the smaller cell. No votes, no blocks.
    """
    r = cells.where("votes > 0").agg(F.sum("votes").alias("v"), F.count("*").alias("k")).first()
    if not r["v"] or blocks <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    near = F.floor(F.col("votes") / F.lit(r["v"] / blocks) + 0.5)
    width = F.ceil(F.col("votes") / F.lit(r["v"]) * r["k"]) + 2
    ranged = cells.withColumn("low", F.when(F.col("votes") > 0, F.greatest(F.lit(0), near - width)).otherwise(0).cast("long")).withColumn("high", F.when(F.col("votes") > 0, near + width).otherwise(-1).cast("long"))
    ranged = materialize(ranged)
    sure = ranged.agg(F.sum("low")).first()[0]
    tried = ranged.where("high >= low").select("cell", "votes", F.explode(F.sequence("low", "high")).alias("s")).select("cell", (F.col("votes") / (2 * F.col("s") + 1)).alias("q"))
    won = tried.orderBy(F.col("q").desc(), "cell").limit(blocks - sure).groupBy("cell").agg(F.count("*").alias("won"))
    return ranged.join(won, "cell", "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("low", "high", "won")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Words to take of every document: ``doc_id, size, source_size, target, taken``.

    docs: ``doc_id``, ``text`` (null: no words), ``source`` (null is one);
    other columns are ignored. A source's documents are dealt by hash into
    shards; equal blocks of words are apportioned to all shards; in each shard
    documents lie end to end in a seeded order, and the first blocks of that
    line are taken after as many whole passes as the quota holds. Rows that
    repeat id, source and text lie together, as one entry with a count, and are
    taken one after the other. No document is taken more than ``most`` times.
    No rows give no rows.
    """
    return _each(_taken(_sized(docs), weights, share, most, seed)).select("doc_id", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` (a hash of the text) with ``alike``, the number of such rows."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    return materialize(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("alike")))


def _taken(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """``sized`` with ``source_size``, ``target``, ``passes`` (whole times that each row is taken) and ``part`` (words of the rows' line taken besides)."""
    whole = F.col("size") * F.col("alike")
    sources = sized.groupBy("source").agg(F.sum(whole).alias("source_size"), F.sum("alike").alias("docs"))
    targets = materialize(source_targets(sources, weights, share, most))
    words = max(SHARD_WORDS, (targets.agg(F.sum("source_size")).first()[0] or 0) // SHARDS)
    targets = targets.withColumn("shards", F.ceil(F.greatest(F.col("source_size") / words, F.col("docs") / (words // 64), F.lit(1))).cast("int"))
    named = targets.select(F.col("source").alias("__source"), "source_size", "target", "shards", "rank")
    # A hot source is one key here; the sizes of its rows are known, and the other side is a row a source.
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn("cell", F.col("rank").cast("long") * (1 << 31) + F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), "shards"))
    cells = placed.groupBy("cell").agg(F.sum(whole).alias("cell_size"), F.first("source_size").alias("s"), F.first("target").alias("t"))
    cells = materialize(cells.withColumn("votes", F.when(F.col("s") > 0, F.col("t") * F.col("cell_size") / F.col("s")).otherwise(0.0)))
    r = cells.where("votes > 0").agg(F.sum("votes").alias("v"), F.count("*").alias("k"), F.min("votes").alias("least")).first()
    total = r["v"] or 0.0
    block = max(1, int(min(total / (1024 * max(1, r["k"])), (r["least"] or 0) / 8)))
    quotas = apportion(cells, round(total / block)).select("cell", "cell_size", F.least(F.col("quota") * block, F.col("cell_size") * most).alias("quota"))
    line = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "h"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    along = placed.withColumn("end", F.sum(whole).over(line)).join(quotas, "cell")
    passes = F.when(F.col("cell_size") > 0, F.expr("quota div nullif(cell_size, 0)")).otherwise(F.lit(0))
    along = along.withColumn("passes", passes)
    over = F.col("quota") - F.col("passes") * F.col("cell_size")
    return along.withColumn("part", F.greatest(F.lit(0), F.least(whole, over - F.col("end") + whole)))


def _each(taken: DataFrame) -> DataFrame:
    """A row for each of the ``alike`` ones, with the words ``taken`` of it."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1, F.lit(COPIES).cast("long")))
    if not taken.where(F.col("alike") > COPIES).isEmpty():
        taken = taken.withColumn("start", start).repartition("doc_id", "h", "start")
    else:
        taken = taken.withColumn("start", F.lit(0).cast("long"))
    nth = F.explode(F.sequence("start", F.least(F.col("start") + COPIES, F.col("alike")) - 1))
    rows = taken.withColumn("nth", nth)
    return rows.withColumn("taken", F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("nth") * F.col("size"))))


@plain_names
def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them, all columns as given: whole copies, then the text cut after its last word taken.

    ``n_chars``, where there is one, follows a cut text. A document without
    words is taken once if anything of its source is. Rows that repeat id,
    source and text share what is taken of them evenly. Nulls and no rows as in ``mix``.
    """
    each = materialize(_taken(_sized(docs), weights, share, most, seed))
    each = each.select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "h")), "size", (F.col("passes") * F.col("size") + F.floor(F.col("part") / F.col("alike"))).cast("long").alias("words"), "target")
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    same = F.col("h") == F.col("__h")
    for c in ("doc_id", "source"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = named.join(each, same)
    copies = F.when(F.col("size") > 0, F.expr("words div nullif(size, 0)")).otherwise(F.when(F.col("target") > 0, 1).otherwise(0))
    left = F.when(F.col("size") > 0, F.expr("words % nullif(size, 0)")).otherwise(0)
    lengths = F.concat(F.array_repeat(F.lit(None).cast("long"), copies.cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<long>")))
    rows = j.select("row", F.explode(lengths).alias("words"))
    cut, n = F.col("words").isNotNull(), F.col("words").cast("int")
    # A word and the white space before it is a piece; only cut texts are split, one a shard at most.
    text = F.when(cut, F.array_join(F.slice(F.split("row.text", WORD_END), 1, n), "")).otherwise(F.col("row.text"))
    made = {"text": text, "n_chars": F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*(made.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))
