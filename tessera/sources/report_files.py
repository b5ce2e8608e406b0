"""A run's reports as UTF-8 markdown files in one folder, by a data-source writer with a commit.

Tasks write ``<path>/<run>/<report>.md`` and a list of what they wrote; the driver commits by writing
the manifest, which names these lists.  A reader goes by the manifest alone, so a run that was aborted
or is still being written holds nothing that can be seen, and files of lost attempts do not count.
"""
from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.sources.files import filesystem, get, put
from tessera.sources.files import listed as listed_files

FORMAT = "tessera_reports"
MANIFEST = "_MANIFEST.json"
_LISTED = "report_id string, file string, n_bytes long, crc32 long"


@dataclass
class _Wrote(WriterCommitMessage):
    listing: str
    reports: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def files(self, iterator) -> Iterator[tuple[str | None, str, bytes]]:
        """(report, file, content) of what a task writes."""
        for batch in iterator:
            for report, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield report, f"{quote(report, safe='')}.md", (body.as_py() or "").encode()

    def manifest(self) -> str:
        return MANIFEST

    def write(self, iterator) -> _Wrote:
        import pyarrow as pa
        import pyarrow.parquet as pq
        system, base = filesystem(f"{self.path}/{self.run}")
        rows = []
        for report, name, data in self.files(iterator):
            put(system, f"{base}/{name}", data)
            rows.append((report, name, len(data), zlib.crc32(data)))
        out = io.BytesIO()
        pq.write_table(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(
            (("report_id", pa.string()), ("file", pa.string()), ("n_bytes", pa.int64()), ("crc32", pa.int64())))}), out)
        # each attempt has a list of its own: the commit names those of the attempts that count
        listing = f"lists/{uuid.uuid4().hex}.parquet"
        put(system, f"{base}/{listing}", out.getvalue())
        return _Wrote(listing, len(rows))

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        system, base = filesystem(f"{self.path}/{self.run}")
        put(system, f"{base}/{self.manifest()}", json.dumps({"lists": [m.listing for m in done], "reports": sum(m.reports for m in done)}).encode())

    def abort(self, messages) -> None:
        """Nothing was committed, so nothing can be seen."""


class _Appender(_Writer):
    """Adds to a run, as often as it is asked.  The rows come in the order of their ids; those of one
    id are one file, each with a newline at its end, in a folder of the task's attempt."""

    def files(self, iterator) -> Iterator[tuple[str | None, str, bytes]]:
        folder = uuid.uuid4().hex
        rows = ((r, b.as_py()) for batch in iterator for r, b in zip(batch.column(0).to_pylist(), batch.column(1)))
        for report, group in groupby(rows, key=lambda x: x[0]):
            name = "null" if report is None else f"id={quote(report, safe='')}"
            yield report, f"{folder}/{name}.md", "".join(f"{body or ''}\n" for _, body in group).encode()

    def manifest(self) -> str:
        return f"{uuid.uuid4().hex}{MANIFEST}"


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return (_Appender if "append" in self.options else _Writer)(self.options["path"], self.options["run"])


def append_reports(reports: DataFrame, path: str, run: str, key: str = "report_id", body: str = "body") -> None:
    """Add reports to a run: a file for each id and task, committed together."""
    spark = reports.sparkSession
    spark.dataSource.register(ReportFiles)
    rows = reports.select(F.col(key).cast("string").alias("report_id"), F.col(body).cast("string").alias("body")).sortWithinPartitions("report_id")
    rows.write.format(FORMAT).mode("append").option("path", path).option("run", run).option("append", "true").save()


def appended_reports(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(report_id string, file, body) of all that was added to a run, a row for each file."""
    at = f"{path.rstrip('/')}/{run}"
    system, base = filesystem(at)
    lists = [f"{at}/{name}" for m in listed_files(system, base, MANIFEST) for name in json.loads(get(system, m))["lists"]]
    return _read(spark, at, lists)


def write_report_run(reports: DataFrame, path: str, run: str, key: str = "report_id", body: str = "body") -> str:
    """Write each report as ``<path>/<run>/<key>.md``; a null body is an empty file.  Ids are unique
    and not null, and a run that was committed is not written again (both are errors)."""
    spark = reports.sparkSession
    system, base = filesystem(f"{path.rstrip('/')}/{run}")
    if system.get_file_info(f"{base}/{MANIFEST}").is_file:
        raise ValueError(f"run {run} was written before")
    bad = reports.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null")
    if not bad.isEmpty():
        raise ValueError("report ids repeat or are null")
    spark.dataSource.register(ReportFiles)
    rows = reports.select(F.col(key).cast("string").alias("report_id"), F.col(body).alias("body"))
    rows.write.format(FORMAT).mode("append").option("path", path).option("run", run).save()
    return path


def read_report_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(report_id string, file, body) of a committed run; each file is checked against its length and
    checksum."""
    at = f"{path.rstrip('/')}/{run}"
    system, base = filesystem(at)
    if not system.get_file_info(f"{base}/{MANIFEST}").is_file:
        raise FileNotFoundError(f"run {run} has no manifest")
    lists = [f"{at}/{name}" for name in json.loads(get(system, f"{base}/{MANIFEST}"))["lists"]]
    return _read(spark, at, lists)


def _read(spark: SparkSession, at: str, lists: list[str]) -> DataFrame:
    listed = spark.read.schema(_LISTED).parquet(*lists) if lists else spark.createDataFrame([], _LISTED)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        fs, folder = filesystem(at)
        for batch in batches:
            for row in batch.to_pylist():
                data = get(fs, f"{folder}/{row['file']}")
                if len(data) != row["n_bytes"] or zlib.crc32(data) != row["crc32"]:
                    raise ValueError(f"{row['file']} is not what was written")
                yield pa.RecordBatch.from_pylist([{"report_id": row["report_id"], "file": row["file"], "body": data.decode()}])
    return listed.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(read, "report_id string, file string, body string")
