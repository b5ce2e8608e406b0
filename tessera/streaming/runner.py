"""Staging and draining helpers for Structured Streaming queries.

* :func:`stage` and :func:`replay` give a DataFrame that Spark derived from a
  table to a file stream in steps, under the shared checkpoint folder; a step
  may be many files and is one micro-batch.
* :func:`drain` runs a streaming DataFrame with ``availableNow`` into a sink
  through ``foreachBatch`` with its checkpoint in the shared folder, and
  returns the sink as a batch DataFrame.  Run again it resumes.  Nothing is
  collected to the driver.
"""
from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir
from tessera.streaming.upsert import UpsertTable


def side_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a side sink under the checkpoint folder."""
    return _path(spark, "side", name)


def _path(spark: SparkSession, kind: str, name: str) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("/"):
        base = os.path.abspath(base)
    return f"{base}/tessera-{kind}-{name}-{uuid.uuid4().hex}"


def _steps(df: DataFrame, name: str, n_steps: int, order=None, scatter=None) -> DataFrame:
    """``df`` written with its step ``_part`` (partitioned by it), each row by the task that holds it.

    ``order`` (a number or time): steps of about equal counts in that order; ``scatter``: the step is
    that expression modulo ``n_steps`` (arrival out of order)."""
    tmp = _path(df.sparkSession, "stage-parts", name)
    if order is not None:
        shares = [i / n_steps for i in range(1, n_steps)]
        cuts = df.agg(F.percentile_approx(order, shares).alias("cuts")).scalar()
        above = [F.when(F.col(order) > F.col("_cuts")[i], 1).otherwise(0) for i in range(n_steps - 1)]
        df = df.withColumn("_cuts", cuts).withColumn("_part", sum(above, F.lit(0))).drop("_cuts")
    else:
        df = df.withColumn("_part", F.pmod(scatter, F.lit(n_steps)).cast("int"))
    df.write.partitionBy("_part").parquet(tmp)
    return df.sparkSession.read.schema(df.schema).parquet(tmp)


def stage(df: DataFrame, name: str, n_steps: int = 4, order=None, scatter=None) -> str:
    """Write ``df`` as parquet files that a file stream replays, step by step; returns the folder."""
    path = _path(df.sparkSession, "stage", name)
    parts = _steps(df, name, n_steps, order, scatter)
    for i in range(n_steps):
        # the file source replays files by modification time: steps are written one after another
        parts.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(path)
    return path


def replay(df: DataFrame, name: str, build, n_steps: int = 4, order=None, scatter=None, **how) -> DataFrame:
    """Give ``df`` to a stream step by step: each step's files are added to the stream's folder and the
    query ``build(source)`` is started from its checkpoint and drained, as often as there are steps.
    All files of a step are one micro-batch.  ``how``: as for :func:`drain`."""
    spark = df.sparkSession
    path, at = _path(spark, "stage", name), _path(spark, "stream", name)
    parts = _steps(df, name, n_steps, order, scatter)
    out = None
    for i in range(n_steps):
        parts.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(path)
        out = drain(build(read_stream(spark, path, df.schema)), name, at=at, **how)
    return out


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Continuous intake of parquet files (messages, chunks, run events).  A micro-batch takes all
    files that are there, or at most ``max_files``."""
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", max_files) if max_files else source).parquet(path)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _read_epochs(spark: SparkSession, path: str, schema) -> DataFrame:
    """All epochs of a sink that were written; empty where there are none yet."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0))


def drain(sdf: DataFrame, name: str, mode: str = "append", side=None, keys: list[str] | None = None,
          at: str | None = None, combine=None) -> DataFrame:
    """Run ``sdf`` until it has taken all that is there (availableNow), and read its sink.

    ``at``: the folder of checkpoint and sink.  Drained again with the same folder the stream goes on
    where it ended, and the sink holds what all runs have written; a fresh folder if none is given.
    ``mode``: ``append`` and ``complete`` write a folder for each epoch; ``update`` needs ``keys`` and
    writes to an :class:`UpsertTable`.  ``side`` = (path, predicate Column): rows of each micro-batch
    that match are also written to ``path``, from the same batch.  ``combine``: applied to each batch
    before it is written."""
    spark = sdf.sparkSession
    at = at or _path(spark, "stream", name)
    sink, schema = f"{at}/sink", sdf.schema
    table = None
    if mode == "update":
        if not keys:
            raise ValueError("update mode needs the keys of its rows")
        table = UpsertTable(spark, sink, keys, schema)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # Idempotent on retry: a re-run micro-batch overwrites its own folders.  In complete mode each
        # epoch is a whole result of its own, and the last one is what is read.
        rows = combine(batch) if combine else batch
        if table is not None:
            table.write(rows, epoch)
        else:
            rows.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        if side is not None:
            # from what was written, so the batch is computed once
            folder = f"{sink}/delta/epoch={epoch}" if table is not None else f"{sink}/epoch={epoch}"
            wrote = spark.read.schema(schema).parquet(folder)
            wrote.filter(side[1]).write.mode("overwrite").parquet(f"{side[0]}/epoch={epoch}")

    # State-store partitions are fixed when a stream first starts: size them
    # to the cluster (at most 2 x its cores), never above the session value.
    key, store = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
    before, before_store = spark.conf.get(key), spark.conf.get(store)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(store, STATE_STORE)
    try:
        q = (sdf.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint")
             .foreachBatch(write_batch).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
        spark.conf.set(store, before_store)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if table is not None:
        return table.read()
    rows = _read_epochs(spark, sink, schema)
    if mode == "complete":
        rows = rows.where(F.col("epoch") == rows.agg(F.max("epoch").alias("e")).scalar())
    return rows.drop("epoch")
