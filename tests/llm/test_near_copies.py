"""Groups that bands chain fall apart by their rare shingles; further columns with any name."""

import pytest
from pyspark.sql import functions as F

from framewise.llm import near_copies, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("own", [20, 6])
def test_template_pages_are_not_compared(spark, monkeypatch, own):
    """100,000 pages in one group, each of a template of 20 shingles and ``own`` ones; every thousandth repeats the page before it but for one."""
    page = F.col("id") - F.when(F.col("id") % 1000 == 1, 1).otherwise(0)
    mine = F.transform(F.sequence(F.lit(0), F.lit(own - 1)), lambda k: 1000 + F.when((k == 0) & (page != F.col("id")), -F.col("id") - 1000).otherwise(page * own + k))
    sets = spark.range(100_000).select(F.lit(0).cast("long").alias("grp"), F.col("id").alias("nid"), F.array_sort(F.concat(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: k.cast("long")), mine)).alias("shingles"))
    compared = []
    searched = near_copies._searched
    monkeypatch.setattr(near_copies, "_searched", lambda pieces: compared.append(pieces.count()) or searched(pieces))
    links = {(r["src"], r["dst"]) for r in near_copies._set_links(near_copies._regrouped(sets)).collect()}
    assert links == {(i + 1, i) for i in range(0, 100_000, 1000)}
    assert compared == [200]


def test_stages_take_columns_of_any_name(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"meta.url": F.lit("u"), "a`b": F.lit(1), "row": F.lit(2), "size": F.lit("s"), "__words": F.lit(3), "h": F.lit(4)})
    names, n = rows.columns, rows.count()
    # withColumn takes "TEXT" for "text", so the clash is made by place.
    rows = rows.toDF(*[c if c != "h" else "TEXT" for c in names])
    for stage in (queries.classify_stage, queries.rules_stage, queries.dedup_stage, queries.mixing_stage):
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns
        assert 0 < len(out.collect()) <= 2 * n


def test_stages_take_columns_of_any_name_as_without(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    dotted = plain.withColumn("meta.url", F.col("doc_id"))
    for stage in (queries.classify_stage, queries.rules_stage, queries.dedup_stage, queries.mixing_stage):
        ids = sorted(r["doc_id"] for r in stage(spark, plain, SF).collect())
        out = stage(spark, dotted, SF).collect()
        assert sorted(r["doc_id"] for r in out) == ids and all(r["meta.url"] == r["doc_id"] for r in out)


def test_simhash_proposes_pairs(spark, monkeypatch):
    """Fingerprints put near copies into a group by themselves; what they propose is counted exactly."""
    monkeypatch.setattr(near_copies, "band_keys", lambda shingles: shingles[:0])
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(1000))
    rows = [(1, text), (2, text + " again"), (3, " ".join(f"v{i}" for i in range(1000))), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == [1, 3, 4]
