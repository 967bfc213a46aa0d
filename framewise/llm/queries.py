"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import chat_tools, embedding_dedup, mixing, near_copies, oracles, packing, quality_classifier, quality_rules, ranked_search, sharding, simhash_dedup, substring_dedup, token_counts, url_filter, vector_codes
from framewise.llm.common import documents, plain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model, ["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tools.events_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_tools.link_calls(calls, results).withColumn("errors", F.array_join("errors", "; "))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(documents(spark, sf_dir), TOKENIZER)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir), 3, 2)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), 13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8, 16, 6)
    return made.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


# Stages of the pipeline: (spark, docs, sf_dir) to a table. All take nulls in any column, empty and very long texts,
# repeated rows, further columns with any name, and no rows; what becomes of these is said with the operator each calls.


def classify_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts as good; it learns from ``labels`` of the rows in ``docs``. A null text is an empty one."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(plain(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules of their language and source (null is a value); a null text fails."""
    return quality_rules.keep_passing(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; rows without doc_id stay."""
    return near_copies.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last one cut after its last word taken; a null source is one."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``packing.pack``; rows that repeat a doc_id, or have none, are documents of their own."""
    return packing.pack(plain(docs), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_embedding_near_dedup, op2_url_filters, op3_quality_classifier, op4_quality_rules, op5_source_mixing, op6_tool_call_linking, op7_packing, op8_token_counts,
        op9_simhash_near_dedup, op10_sharding, op11_substring_dedup, op12_ranked_search, op13_vector_codes,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express whole; the others train, tokenize or hash and are tested against brute force."""
    return {"op1_embedding_near_dedup": oracles.op1(), "op4_quality_rules": oracles.op4(), "op6_tool_call_linking": oracles.op6(), "op11_substring_dedup": oracles.op11(), "op12_ranked_search": oracles.op12(), "op13_vector_codes": oracles.op13()}
