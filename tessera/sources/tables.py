"""Table readers with enforced schemas (S1 ``corpus`` and the other driver tables).

Reading with an explicit schema skips footer-based inference, and because
every operator selects only the columns it needs, Catalyst prunes the
parquet ``ReadSchema`` down to those columns and pushes filters into the
scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Tables whose rows carry long text: regex work per row dominates, so a
# scan with fewer splits than cores is spread before that work starts.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over the cluster's cores when it has fewer splits.

    Decided at planning time from the file splits.  On a large table the
    scan already has thousands of splits and this is a no-op; on a single
    large row group it turns one long task into ``defaultParallelism``.
    """
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): leave the scan as is
        return df
    return df.repartition(par) if n < par else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; known tables get their schema enforced."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    return spread(df) if name in TEXT_TABLES else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document corpus that replaces the hosted search index."""
    return load(spark, sf_dir, "documents")
