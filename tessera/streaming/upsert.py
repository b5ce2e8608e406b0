"""A table that streams in update mode write to: one row for each key, the latest.

An epoch writes its changed rows and nothing else.  A reader takes for each key the row of its latest
epoch.  When the changes since the last compaction hold as many rows as the table, they are merged
into a new base, so the rows written stay within a constant factor of the rows changed.  An epoch
that is run again overwrites its own folder; what is finished is listed in a manifest, which is
written last, so half-written folders are never read.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: changed rows below which nothing is merged
LEAST_ROWS = 10_000
_MANIFEST = "kind string, epoch long, n_rows long"


class UpsertTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, least_rows: int = LEAST_ROWS):
        self.spark, self.path, self.keys, self.schema, self.least = spark, path.rstrip("/"), keys, schema, least_rows

    def _done(self) -> tuple[int, int, dict[int, int]]:
        """(base epoch, its rows, {epoch: rows} of the changes since); -1: no base."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        base, n = max(((r.epoch, r.n_rows) for r in rows if r.kind == "base"), default=(-1, 0))
        return base, n, {r.epoch: r.n_rows for r in rows if r.kind == "delta" and r.epoch > base}

    def _finish(self, kind: str, epoch: int, n: int) -> None:
        self.spark.createDataFrame([(kind, epoch, n)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def write(self, batch: DataFrame, epoch: int) -> None:
        """The changed rows of an epoch, at most one for each key; may be called again for it."""
        at = f"{self.path}/delta/epoch={epoch}"
        batch.write.mode("overwrite").parquet(at)
        n = self.spark.read.schema(self.schema).parquet(at).count()
        self._finish("delta", epoch, n)
        base, size, deltas = self._done()
        if sum(deltas.values()) >= max(size, self.least):
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        at = f"{self.path}/base/upto={epoch}"
        self.read().write.mode("overwrite").parquet(at)
        self._finish("base", epoch, self.spark.read.schema(self.schema).parquet(at).count())

    def read(self) -> DataFrame:
        base, _, deltas = self._done()
        parts = [(base, f"{self.path}/base/upto={base}")] if base >= 0 else []
        parts += [(e, f"{self.path}/delta/epoch={e}") for e in sorted(deltas)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for epoch, at in parts:
            part = self.spark.read.schema(self.schema).parquet(at).withColumn("_epoch", F.lit(epoch).cast("long"))
            rows = part if rows is None else rows.unionByName(part)
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_epoch"])
        latest = rows.groupBy(*self.keys).agg(F.max_by(whole, "_epoch").alias("_row"))
        return latest.select("_row.*")

    def rows_written(self) -> int:
        """Rows that epochs and compactions have written since the table began."""
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").agg(F.sum("n_rows")).first()[0] or 0
