"""Write reports as UTF-8 markdown, one file per report, grouped by run.

Tasks write the files themselves into ``run_ts=<stamp>/`` (a folder for each
task, not for each report) and list them; a write is seen once its manifest
is there.  Each body ends with a newline in its file, which reading takes
off again, and reading goes by the lists, so no folder tree is searched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import filesystem
from tessera.sources.report_files import append_reports, appended_reports

RUN_TS_FORMAT = "yyyyMMdd_HHmmss"


def write_reports(reports: DataFrame, path: str, run_ts: str | None = None,
                  key: str = "report_id", body: str = "body") -> str:
    stamp = run_ts or reports.sparkSession.range(1).select(F.date_format(F.current_timestamp(), RUN_TS_FORMAT)).first()[0]
    append_reports(reports, path, f"run_ts={stamp}", key, body)
    return path


def read_reports(spark: SparkSession, path: str, key: str = "report_id") -> DataFrame:
    """(run_ts, report_id, body) from a folder written by :func:`write_reports`."""
    from pyarrow import fs
    system, base = filesystem(path.rstrip("/"))
    runs = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("run_ts="))
    out = None
    for run in runs:
        rows = appended_reports(spark, path, run).select(
            F.lit(run.partition("=")[2]).alias("run_ts"), F.col("report_id").cast("bigint").alias(key),
            F.expr("substring(body, 1, length(body) - 1)").alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"run_ts string, {key} bigint, body string") if out is None else out
