"""Spherical k-means over rows of vectors, as Spark passes.

Each iteration is one pass: a task multiplies its rows with the centroids in NumPy and gives one sum
for each centroid and dimension; the sums are added by Spark, and k x dims numbers reach the driver.
The start is the ``k`` rows with the smallest hash of seed and id, so a run can be repeated (and
written as SQL); ties go to the smaller theme; a theme that no row joins keeps its centroid.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048
TIE_DIGITS = 9


def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a direction, their unit vectors as doubles) of an Arrow list column whose vectors
    have one length; null vectors, vectors with null or non-finite components and zero vectors have none."""
    n = len(col)
    sizes = np.diff(col.offsets.to_numpy())
    width = int(sizes.max()) if n else 0
    full = (sizes == width) & col.is_valid().to_numpy(zero_copy_only=False) if width else np.zeros(n, bool)
    rows = np.flatnonzero(full)
    if not len(rows):
        return rows, np.zeros((0, width))
    x = col.filter(pa.array(full)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def nearest(similarities: np.ndarray) -> np.ndarray:
    """The best column of each row; equal to TIE_DIGITS places: the smaller one."""
    return np.argmax(np.round(similarities, TIE_DIGITS), 1)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in slices(batches):
            _, x = matrix(b.column(0))
            if not len(x):
                continue
            best = nearest(x @ centroids.T)
            member = np.zeros((len(centroids), len(x)))
            member[best, np.arange(len(x))] = 1
            total += member @ x
            n += np.bincount(best, minlength=len(centroids))
        theme, dim = np.nonzero(total)
        if len(theme):
            yield pa.RecordBatch.from_arrays([pa.array(theme, pa.int32()), pa.array(dim, pa.int32()), pa.array(total[theme, dim])], ["theme", "dim", "x"])
    return run


def starts(vectors: DataFrame, k: int, seed: int, id_col: str, vec: str) -> np.ndarray:
    """The k rows with the smallest md5 of "seed:id" (then id)."""
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    alive = F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    rows = vectors.where(alive).select(F.col(vec).alias("v"), key.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(k).collect()
    x = np.array([r.v for r in rows], float).reshape(len(rows), len(rows[0].v) if rows else 0)
    return x / np.sqrt((x * x).sum(1))[:, None]


def spherical_kmeans(vectors: DataFrame, k: int, id_col: str, vec: str, seed: int = 7, iterations: int = 10) -> np.ndarray:
    """Unit centroids (at most k; none for a table without vectors).  ``vectors`` is read once for each
    iteration: hand over a written table."""
    centroids = starts(vectors, k, seed, id_col, vec)
    for _ in range(iterations if len(centroids) else 0):
        sums = (vectors.select(vec).mapInArrow(_sums(centroids), "theme int, dim int, x double")
                .groupBy("theme", "dim").agg(F.sum("x").alias("x")).toPandas())
        new = np.zeros_like(centroids)
        new[sums["theme"], sums["dim"]] = sums["x"]
        norm = np.sqrt((new * new).sum(1))
        new = np.where(norm[:, None] > 0, new / np.where(norm > 0, norm, 1)[:, None], centroids)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str, vec: str) -> DataFrame:
    """(id, theme bigint, similarity): the nearest centroid by cosine; null for rows without a direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, x = matrix(b.column(1))
            theme, sim = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            none = np.ones(b.num_rows, bool)
            if len(rows) and len(centroids):
                s = x @ centroids.T
                theme[rows] = nearest(s)
                sim[rows] = s[np.arange(len(rows)), theme[rows]]
                none[rows] = False
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(theme, mask=none), pa.array(sim, mask=none)], [id_col, "theme", "similarity"])
    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec).mapInArrow(run, f"`{id_col}` {kind}, theme long, similarity double")
