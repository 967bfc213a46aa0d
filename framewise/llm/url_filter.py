"""URL filters: rules first, then gradient-boosted trees on lexical features of the URL."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import materialize

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled URLs of each verdict at most that the trees are grown on.
SAMPLE = 4_000
TREES, DEPTH, SEED = 20, 4, 3
FOLDS = 4
#: Pseudo-count with which a suffix's or word's share of blocked URLs is drawn to the overall share.
PRIOR = 20.0
FEATURES = ["url_len", "host_len", "path_len", "query_len", "depth", "labels", "digit_ratio", "host_entropy", "path_entropy", "params", "hyphens", "fragment", "secure", "suffix_rate", "site_rate", "top_rate"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from there up to ``? #``. Both empty without ``://`` or for null."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A handful of rules, so a chain of conditions, longest first."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def _entropy(text: Column) -> Column:
    """Bits a character: sorted, equal characters are runs, so a long text costs a sort."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    share = F.transform(runs, lambda r: F.length(r) / F.greatest(F.length(text), F.lit(1)))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def _keys(host: Column, path: Column) -> dict[str, Column]:
    """What the suffix statistics are kept by: last host label, last two labels, and the first part of the path with the last label."""
    last = F.substring_index(host, ".", -1)
    return {"suffix_rate": last, "site_rate": F.substring_index(host, ".", -2), "top_rate": F.try_element_at(F.split(path, "/"), F.lit(2))}


def _lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    return rows.withColumns({
        "url_len": F.length(url).cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"), "query_len": F.length(query).cast("double"),
        "depth": count(path, "/[^/]"), "labels": count(host, r"\."), "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_entropy": _entropy(host), "path_entropy": _entropy(path),
        "params": count(query, "[^=&]+="), "hyphens": count(host, "-"), "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.lower(F.substring(url, 1, 6)).eqNullSafe("https:").cast("double"),
    })


def _with_rates(rows: DataFrame, sums: dict[str, DataFrame], overall: float, fold: Column | None = None) -> DataFrame:
    """``rows`` with the share of blocked URLs of each key, drawn to ``overall``; with ``fold``, of the URLs of all other folds."""
    for name, key in _keys(F.col("host"), F.col("path")).items():
        by = sums[name]
        if fold is None:
            by = by.groupBy("key").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        else:
            total = by.groupBy(F.col("key").alias("__all")).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
            by = by.join(total, F.col("key").eqNullSafe(F.col("__all"))).select("key", "fold", (F.col("ts") - F.col("s")).alias("s"), (F.col("tn") - F.col("n")).alias("n"))
        rate = by.select(F.col("key").alias("__r"), *([F.col("fold").alias("__f")] if fold is not None else []), ((F.col("s") + PRIOR * overall) / (F.col("n") + PRIOR)).alias(name))
        on = F.col("__k").eqNullSafe(F.col("__r"))
        keyed = rows.withColumn("__k", key)
        if fold is not None:
            keyed, on = keyed.withColumn("__g", fold), on & (F.col("__g") == F.col("__f"))
        rows = keyed.join(rate, on, "left").drop("__k", "__r", "__g", "__f").withColumn(name, F.coalesce(name, F.lit(overall)))
    return rows


def fit(parts: DataFrame) -> tuple[GBTClassificationModel | None, dict[str, DataFrame], float]:
    """Suffix statistics over all labelled URLs, and trees grown on at most ``SAMPLE`` of each verdict, the first by a hash.

    parts: ``url, host, path, verdict`` (null: not labelled). Equal URLs share
    a fold, and the trees see each URL with the statistics of the other folds,
    so they learn how far these hold for URLs not met before.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    known = parts.where("verdict IS NOT NULL").withColumn("y", (F.col("verdict") == "block").cast("double"))
    overall = known.agg(F.avg("y")).first()[0]
    overall = 0.0 if overall is None else overall
    sums = {
        name: materialize(known.groupBy(key.alias("key"), fold.alias("fold")).agg(F.sum("y").alias("s"), F.count("*").alias("n")))
        for name, key in _keys(F.col("host"), F.col("path")).items()
    }
    if not 0 < overall < 1:
        return None, sums, overall
    order = known.select("url", "host", "path", "y").distinct().withColumn("h", F.xxhash64(F.lit(SEED), "url"))
    chosen = order.where("y = 1").orderBy("h", "url").limit(SAMPLE).unionByName(order.where("y = 0").orderBy("h", "url").limit(SAMPLE))
    rows = materialize(_with_rates(_lexical(chosen), sums, overall, fold).select("y", *FEATURES))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(2))
    return GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors.select("y", "features")), sums, overall


def score(parts: DataFrame, model: GBTClassificationModel | None, sums: dict[str, DataFrame], overall: float) -> DataFrame:
    """``parts`` with ``score``, the trees' share for block; ``overall`` where only one verdict is known."""
    if model is None:
        return parts.withColumn("score", F.lit(float(overall)))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_rates(_lexical(parts), sums, overall))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def filter_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict, score``.

    pages: ``page_id`` and ``url``; other columns are ignored. The verdict is
    that of the longest rule that fits; else ``block`` if the trees' score
    reaches ``threshold``, and ``allow`` below. URLs that rules judge are the
    labelled ones the trees learn from. Null, empty and odd URLs have an empty
    host and path and are judged by the trees; repeated rows are judged each;
    with one verdict or none among the labelled, that verdict (else ``allow``)
    holds for all. No rows give no rows.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("verdict", verdict)
    scored = score(parts, *fit(parts))
    judged = F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")
