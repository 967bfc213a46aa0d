"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import map_texts, materialize, plain_names, small_batches

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
MIN_WORDS = 50
#: The sketch's relative error: a bucket spans values whose ratio is GAMMA.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Documents that a language's sketch counts as in each of its groups, and that of all documents in each language.
PRIOR = 50
#: Places of a metric's values, on which clusters are told apart: one step is a resolution of the metric, from which on values differ by a factor.
AXES = {
    "symbols": "ln(1 + x / 0.02)",
    "dup_lines": "ln(1 + x / 0.2)",
    "repeats": "ln(1 + x / 0.05)",
    "mean_word": "10 * ln(x)",
}
#: Metrics that may be too low as well as too high: there the smaller cluster goes.
TWO_SIDED = ("mean_word",)
#: Clusters are apart if the distance of their means is so many times their root mean square spread, counted as SPREAD at least.
APART, SPREAD = 4.0, 0.4
ZERO = -(2**31)
METRICS = {
    "symbols": "try_divide(n_symbols, n_words)",
    "dup_lines": "try_divide(n_dup_lines, n_lines)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "mean_word": "try_divide(word_chars, n_words)",
}


def text_stats(text: bytes) -> tuple[int, ...]:
    """``STATS`` of one whole text; words are runs of anything but ASCII white space."""
    w = text.split()
    n = len(w)
    chars = len(b"".join(w).decode())
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    triples = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(triples)) < len(triples):
        count = Counter(triples)
        last = -1  # last word counted
        for i, t in enumerate(triples):
            if count[t] > 1:
                repeat += i + 2 - max(i - 1, last)
                last = i + 2
    return n, chars, symbols, dup, repeat, len(lines)


def _stats_of(texts: list[bytes]) -> list[pa.Array]:
    rows = [text_stats(t) for t in texts]
    return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(x: Column) -> Column:
    """Bucket of a value: ceil(ln x / ln GAMMA), zero in one of its own."""
    return F.when(x > 0, F.ceil(F.log(x) / math.log(GAMMA)).cast("int")).otherwise(F.lit(ZERO))


def sketches(stats: DataFrame) -> DataFrame:
    """Mergeable quantile sketch of every metric in every (lang, source).

    A sketch is the counts of its buckets, and sketches merge by adding
    counts. Its size is bounded by the range of the values, not by their number.
    """
    metric = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.expr(v).alias("x")) for k, v in METRICS.items())))
    each = stats.where(~base_failed()).select("lang", "source", metric.alias("m")).select("lang", "source", "m.*")
    return each.groupBy("lang", "source", "metric", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def weighted(sketch: DataFrame) -> DataFrame:
    """``lang, source, metric, bucket, n``: each group's sketch merged with its language's, as of ``PRIOR`` documents, that one merged likewise with the sketch of all.

    A large group is nearly its own, a small one nearly its language's; there is no size at which one takes over.
    """

    def under(own: DataFrame, keys: list[str], above: DataFrame, by: list[str]) -> DataFrame:
        share = F.lit(float(PRIOR)) * F.col("n") / F.sum("n").over(Window.partitionBy(*by, "metric"))  # a window is the buckets of one sketch
        known = above.withColumn("n", share).withColumnsRenamed({c: f"__{c}" for c in [*by, "metric"]})
        same = F.col("metric") == F.col("__metric")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        lent = own.select(*keys, "metric").distinct().join(known, same).select(*keys, "metric", "bucket", "n")
        every = own.select(*keys, "metric", "bucket", F.col("n").cast("double").alias("n")).unionByName(lent)
        return every.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))

    sketch = materialize(sketch)
    every = sketch.groupBy("metric", "bucket").agg(F.sum("n").cast("double").alias("n"))
    langs = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    return under(sketch, ["lang", "source"], materialize(under(langs, ["lang"], every, [])), ["lang"])


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and for each metric the highest bucket that is kept (``high_``) and the lowest (``low_``); null where nothing is too high, or too low.

    The sketch is cut in two where the variance between the parts is largest
    (Otsu). If the parts are apart, they are two clusters, and the outer one
    goes, whatever its share: the higher, or, for ``TWO_SIDED`` metrics, the
    smaller. If not, it is one cluster, and nobody's outer tenth goes.
    """
    part = Window.partitionBy("lang", "source", "metric")
    along = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    x = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    place = F.coalesce(*(F.when(F.col("metric") == m, F.expr(e)) for m, e in AXES.items()))
    rows = weighted(sketch).withColumn("x", x).withColumn("y", place).withColumns({"n1": F.col("n") * F.col("y"), "n2": F.col("n") * F.col("y") * F.col("y")})
    rows = rows.withColumns({c: F.sum(n).over(along) for c, n in (("w", "n"), ("m", "n1"), ("q", "n2"))} | {c: F.sum(n).over(part) for c, n in (("ws", "n"), ("ms", "n1"), ("qs", "n2"))})
    rows = rows.withColumn("last", F.lead("bucket").over(part.orderBy("bucket")).isNull()).where("NOT last")
    between = F.pow(F.col("ms") * F.col("w") / F.col("ws") - F.col("m"), 2) / (F.col("w") * (F.col("ws") - F.col("w")))
    cut = F.max_by(F.struct("bucket", "w", "m", "q", "ws", "ms", "qs"), F.struct(between, -F.col("bucket").cast("long")))
    cuts = rows.groupBy("lang", "source", "metric").agg(cut.alias("c")).select("lang", "source", "metric", "c.*")
    above = F.col("ws") - F.col("w")
    mean, mean_above = F.col("m") / F.col("w"), (F.col("ms") - F.col("m")) / above
    spread = F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(SPREAD**2)) + F.greatest((F.col("qs") - F.col("q")) / above - mean_above * mean_above, F.lit(SPREAD**2))
    apart = mean_above - mean >= F.lit(APART) * F.sqrt(spread / 2)
    upper = ~F.col("metric").isin(*TWO_SIDED) | (2 * above <= F.col("ws"))
    cuts = cuts.withColumns({"high": F.when(apart & upper, F.col("bucket")), "low": F.when(apart & ~upper, F.col("bucket") + 1)})
    each = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("high", "low")]
    return cuts.groupBy("lang", "source").agg(*each)


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``, by a join with the thresholds of each row's language and source."""
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    # The small table's size is known (it was written), so Spark broadcasts it or sorts and merges.
    j = stats.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    fine = ~base_failed()
    for m, value in METRICS.items():
        at = bucket(F.expr(value))
        fine = fine & F.coalesce(at <= F.col(f"high_{m}"), F.lit(True)) & F.coalesce(at >= F.col(f"low_{m}"), F.lit(True))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", fine)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judge every document: ``doc_id``, ``STATS``, ``base_failed`` and ``kept``.

    docs: ``doc_id``, ``text``, ``lang``, ``source``; other columns are ignored.
    A null text has no words and fails; a null language or source is a group
    of its own. Repeated rows are judged each, ties at a threshold stay together,
    and no rows give no rows. Documents that fail the base rules stay out of
    the sketches.
    """
    stats = materialize(map_texts(docs, ["doc_id", "lang", "source"], [T.StructField(s, T.LongType()) for s in STATS], _stats_of))
    limits = materialize(thresholds(sketches(stats)))
    return judged(stats, limits).select("doc_id", *STATS, "base_failed", "kept")


@plain_names
def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass ``quality_rules``, all columns as given.

    Null texts have no words and go, a null language or source is a group,
    repeated rows are judged each, no rows give no rows. The statistics are
    computed twice, so no text is shuffled.
    """
    stats = map_texts(docs, ["lang", "source"], [T.StructField(s, T.LongType()) for s in STATS], _stats_of)
    limits = materialize(thresholds(sketches(stats)))
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("lang", docs.schema["lang"].dataType), T.StructField("source", docs.schema["source"].dataType), T.StructField("row", docs.schema), *(T.StructField(s, T.LongType()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), row, *_stats_of(texts)], names=schema.names)

    return judged(docs.mapInArrow(run, schema), limits).where("kept").select("row.*")
