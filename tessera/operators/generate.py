"""Run a user function over a table of prompts.

The function (e.g. a model client) runs in tasks.  A prompt gets up to ``max_attempts`` tries with
waits between them (none after the last); one that keeps failing carries its last error in a column,
so one bad prompt never costs the job.

With a ``ledger`` folder the work can be resumed: prompts are dealt into buckets by their SHA-256, and
a task writes what it has finished to its bucket of the ledger every ``FLUSH_SECONDS`` or ``FLUSH_ROWS``
prompts.  Before it calls the function a task reads its bucket, so neither an executor that is lost,
nor a job that is run again, nor a prompt that stands twice, is a second call; what was in work when
the executor was lost is the exception.  (Spark must not run a task twice at a time: keep speculation
off for calls that cost.)
"""
from __future__ import annotations

import io
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.files import filesystem, get, listed, put

# --- fixed values (must equal the reference's rules) -----------------------
MAX_ATTEMPTS = 3
#: seconds waited after the first and the second failed attempt
WAITS = (1.0, 2.0)
# ---------------------------------------------------------------------------
#: prompts of a bucket, about: what a task holds of the ledger at a time
BUCKET_ROWS = 20_000
FLUSH_ROWS, FLUSH_SECONDS = 200, 30.0


def attempt(fn: Callable[[str, int], str], prompt: str, max_attempts: int = MAX_ATTEMPTS, waits: tuple[float, ...] = WAITS,
            sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(output, error, attempts) of one prompt.  After failed attempt i waits ``waits[i - 1]`` seconds
    (the last of ``waits`` where there are more attempts)."""
    err = None
    for n in range(1, max_attempts + 1):
        try:
            return fn(prompt, n), None, n
        except Exception as e:  # noqa: BLE001 - recorded per row
            err = f"{type(e).__name__}: {e}"
        if n < max_attempts and waits:
            sleep(waits[min(n, len(waits)) - 1])
    return None, err, max_attempts


class Ledger:
    """Finished prompts of one bucket: {sha256: (output, error, attempts)}, and what is not written yet."""

    def __init__(self, path: str, bucket: int, retry_errors: bool):
        import pyarrow.parquet as pq
        self.system, self.folder = filesystem(f"{path.rstrip('/')}/bucket={bucket}")
        self.done: dict[str, tuple] = {}
        self.new: list[tuple] = []
        self.last = time.monotonic()
        for f in listed(self.system, self.folder, ".parquet"):
            for r in pq.read_table(io.BytesIO(get(self.system, f))).to_pylist():
                if not retry_errors or r["error"] is None:
                    self.done[r["sha"]] = (r["output"], r["error"], r["attempts"])

    def add(self, sha: str, result: tuple) -> None:
        self.done[sha] = result
        self.new.append((sha, *result))
        if len(self.new) >= FLUSH_ROWS or time.monotonic() - self.last > FLUSH_SECONDS:
            self.flush()

    def flush(self) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq
        if self.new:
            out = io.BytesIO()
            cols = zip(("sha", "output", "error", "attempts"), zip(*self.new), (pa.string(), pa.string(), pa.string(), pa.int64()))
            pq.write_table(pa.table({name: pa.array(values, kind) for name, values, kind in cols}), out)
            put(self.system, f"{self.folder}/{uuid.uuid4().hex}.parquet", out.getvalue())
        self.new, self.last = [], time.monotonic()


def batch_generate(df: DataFrame, key: str, prompt_col: str, fn: Callable[[str, int], str],
                   max_attempts: int = MAX_ATTEMPTS, waits: tuple[float, ...] = WAITS,
                   sleep: Callable[[float], None] = time.sleep, ledger: str | None = None, buckets: int | None = None,
                   retry_errors: bool = True) -> DataFrame:
    """(key, output, error, attempts).  ``fn(prompt, attempt)`` returns text or raises; ``attempt`` is
    1-based.  ``ledger``: a folder that all executors share; prompts found there are not run again
    (failed ones are, unless ``retry_errors`` is false).  ``buckets`` must be the same for all runs over
    a ledger; by default it follows the number of rows."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("output", T.StringType()),
                           T.StructField("error", T.StringType()), T.StructField("attempts", T.LongType())])
    names = schema.fieldNames()

    def result(pdf_key, results):
        import pandas as pd
        return pd.DataFrame({key: pdf_key, **{c: pd.Series([r[i] for r in results], index=pdf_key.index, dtype=object) for i, c in enumerate(names[1:])}})

    if ledger is None:
        def run(batches: Iterator) -> Iterator:
            for pdf in batches:
                yield result(pdf[key], [attempt(fn, p, max_attempts, waits, sleep) for p in pdf[prompt_col]])
        return df.select(key, prompt_col).mapInPandas(run, schema)

    if buckets is None:
        buckets = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // BUCKET_ROWS))

    def resume(batches: Iterator) -> Iterator:
        now, book = None, None
        try:
            for pdf in batches:
                results = []
                for bucket, sha, prompt in zip(pdf["_bucket"], pdf["_sha"], pdf[prompt_col]):
                    if bucket != now:
                        if book is not None:
                            book.flush()
                        now, book = bucket, Ledger(ledger, bucket, retry_errors)
                    if sha not in book.done:
                        book.add(sha, attempt(fn, prompt, max_attempts, waits, sleep))
                    results.append(book.done[sha])
                yield result(pdf[key], results)
        finally:
            # also when the task is cancelled or its reader stops early
            if book is not None:
                book.flush()

    sha = F.sha2(F.coalesce(F.concat(F.lit("p"), prompt_col), F.lit("null")), 256)
    rows = df.select(key, prompt_col, sha.alias("_sha"), F.pmod(F.xxhash64(sha), F.lit(buckets)).cast("int").alias("_bucket"))
    return rows.repartition(buckets, "_bucket").sortWithinPartitions("_bucket").mapInPandas(resume, schema)
