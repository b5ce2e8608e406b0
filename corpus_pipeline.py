"""Corpus pipeline: quality classifier, SimHash near-duplicates, personal data, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that its predecessor kept; ``run``
writes each result as Parquet in the shared folder and reads it again as the next one's input.  All
but the last return the columns of ``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, pii, quality_classifier, simhash
from tessera.session import checkpoint_dir, configure, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: share of the words of what is left that the mixture holds
MIX_SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates one document stays: the one with the smallest
    doc_id (of several rows with that id, one).  Rows without an id that are near no other stay."""
    configure(spark)
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    # rows are told apart by their number, so repeated and null doc_ids are documents like others
    groups = materialize(simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
                         .select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "pipeline-groups")
    best = (rows.select("row", "doc_id").join(groups, "row")
            .groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")))
    return rows.join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    configure(spark)
    tagger = pii.train(docs)
    found = pii.find(docs.select(*COLUMNS), tagger, redacted=True, keep=["lang", "source"])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, a row for each time one is drawn."""
    configure(spark)
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-mix")
    drawn = mixing.select(rows, budget_share=MIX_SHARE, keep=["row"]).select("row", F.sequence(F.lit(1).cast("long"), "copies").alias("copy"))
    return rows.join(drawn, "row").select(*COLUMNS, F.explode("copy").alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 1024 tokens."""
    configure(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("PII", personal_data),
          ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: learned models and tokenizers are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
