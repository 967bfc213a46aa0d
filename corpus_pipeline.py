"""The corpus pipeline: raw documents to packed training sequences.

Each stage works on all that the stage before it kept, written as Parquet in
the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import queries as q
from framewise.llm.common import documents, materialize, release

STAGES = [
    ("quality classifier", q.classify_stage),
    ("quality rules", q.rules_stage),
    ("simhash near-dedup", q.dedup_stage),
    ("source mixing", q.mixing_stage),
    ("packing", q.packing_stage),
]

#: The classifier is trained, packing tokenizes: SQL can't express them. Each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of ``documents``: a row a piece, as ``packing.pack`` gives them.

    Nulls, empty and very long texts, repeated rows, further columns and an
    empty table are dealt with stage by stage (see the stages in
    ``framewise/llm/queries.py``). What a stage hands on is deleted once the
    next one is written.
    """
    docs = documents(spark, sf_dir)
    before = None
    for _, stage in STAGES:
        docs, last = materialize(stage(spark, docs, sf_dir)), before
        if last is not None:
            release(last)
        before = docs
    return docs
