"""Registered queries of the training-data operators, and the SQL that states their results."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, prefix_trie, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_policy, ledger, policy_mask
    led = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return led.withColumn("base_failed", F.expr(f"(failed & {policy_mask('base')}L) != 0"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"))


@query("op6_simhash_near_duplicates")
def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_minimax_shards")
def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard
    return (shard(table(spark, sf_dir, "documents"), 24)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


@query("op10_embedding_near_duplicates")
def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "log_odds")


@query("op4_hierarchical_mixing", mixing.SQL)
def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


@query("op9_cotrained_quality")
def op9_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "score", "kept")


@query("op8_pii_spans")
def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, train
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", spelling.SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", prefix_trie.SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
