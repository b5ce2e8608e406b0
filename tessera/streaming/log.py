"""A log of thread messages, and the streaming source that polls it by offset.

``append`` adds one numbered part to the log, written by Spark in ranges of threads.  The source's
offset is the number of finished parts (those with Spark's ``_SUCCESS``); a micro-batch takes the
parts between two offsets, one task for each file, that is for each range of threads.  A stream that
is started again from its checkpoint goes on at the offset where it ended, so it gives each message
once.  Tasks read with pyarrow, batch by batch; the folder must be one that its file systems reach.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources.files import filesystem

FORMAT = "tessera_thread_log"
ROWS = 10_000


def _parts(path: str) -> list[int]:
    """Numbers of the parts in the log's folder that are finished, as far as none is missing."""
    from pyarrow import fs
    system, base = filesystem(path)
    found = {}
    for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        m = re.search(r"/part=(\d+)/_SUCCESS$", f.path)
        if m:
            found[int(m.group(1))] = True
    n = 0
    while n in found:
        n += 1
    return list(range(n))


def append(messages: DataFrame, path: str, thread: str, order: str, n_ranges: int | None = None) -> int:
    """Add rows as the log's next part; returns its number.  One writer at a time."""
    path = path.rstrip("/")
    number = len(_parts(path))
    ranged = messages.repartitionByRange(n_ranges, thread, order) if n_ranges else messages.repartitionByRange(thread, order)
    ranged.sortWithinPartitions(thread, order).write.mode("overwrite").parquet(f"{path}/part={number}")
    return number


class _File(InputPartition):
    def __init__(self, path: str):
        self.value = path


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, schema):
        self.path, self.columns, self.schema = path, [f.name for f in schema.fields], schema

    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": len(_parts(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs
        system, base = filesystem(self.path)
        files = []
        for part in range(start["parts"], end["parts"]):
            inside = system.get_file_info(fs.FileSelector(f"{base}/part={part}"))
            files += [_File(f.path) for f in sorted(inside, key=lambda f: f.path) if f.path.endswith(".parquet")]
        return files

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        system, _ = filesystem(self.path)
        wanted = to_arrow_schema(self.schema)
        with system.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f).iter_batches(ROWS, columns=self.columns):
                yield batch.select(self.columns).cast(wanted)

    def commit(self, end: dict) -> None:
        pass


class ThreadLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"].rstrip("/"), schema)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log as a stream of its messages; ``schema``: the columns to read."""
    spark.dataSource.register(ThreadLog)
    return spark.readStream.format(FORMAT).schema(schema).option("path", path).load()
