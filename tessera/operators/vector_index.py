"""Semantic search over an inverted-file index of vectors.

Vectors are grouped into about sqrt(n) cells around spherical k-means centroids and written
partitioned by cell.  A query probes the cells whose centroids are nearest; only their folders are
read, and a task keeps at most k hits for each query, so no (vector, query) rows are made.

The centroids are fitted on a bounded sample (``SAMPLE_PER_CELL`` rows for each cell); every vector is
indexed.  How many cells a query probes is measured when the index is built: the exact neighbours of
``CALIBRATION`` of the vectors say in which cells they lie, and the smallest number that reaches the
asked recall is kept.  ``exact=True`` goes on after the probes: with the k-th best score so far, the
angle to a centroid and the cell's widest angle rule out the cells that cannot hold anything better,
and the rest are read.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.kmeans import matrix, slices, spherical_kmeans
from tessera.session import checkpoint_dir, materialize

MAX_CELLS = 4096
SAMPLE_PER_CELL = 64
CALIBRATION = 64
RECALL = 0.97
#: queries that are answered in one pass over their cells
MAX_QUERIES = 4096
SCORE_DIGITS = 4
#: a cell stays in question while it may hold a score that rounds to the k-th best
MARGIN = 10.0 ** -SCORE_DIGITS


@dataclass(frozen=True)
class VectorIndex:
    """A written index.  ``centroids`` and ``radius`` (the widest angle of each cell) are at most
    MAX_CELLS rows; ``probes`` is the calibrated number of cells for each query."""
    path: str
    id_col: str
    schema: str
    centroids: np.ndarray
    radius: np.ndarray
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")


def _cells(centroids: np.ndarray, id_col: str):
    """Rows with their cell and angle to its centroid; rows without a direction are left out, they
    have no cosine with anything."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, x = matrix(b.column(1))
            if len(rows):
                s = x @ centroids.T
                cell = np.argmax(s, 1)
                angle = np.arccos(np.clip(s[np.arange(len(rows)), cell], -1, 1))
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array(angle)], [id_col, "vec", "cell", "angle"])
    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cells: int | None = None,
                path: str | None = None, recall: float = RECALL, k: int = 10, seed: int = 7) -> VectorIndex:
    """Write the index of (id, vector) rows to ``path`` (default: the shared checkpoint folder)."""
    spark = vectors.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tessera-ivf-{uuid.uuid4().hex}"
    rows = materialize(vectors.select(id_col, F.col(vec).alias("vec")), "ivf-vectors")
    n = rows.count()
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    scale = 1 << 30
    share = min(scale, math.ceil(scale * SAMPLE_PER_CELL * cells / max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(scale)) < share)
    sample = materialize(sample, "ivf-sample") if share < scale else rows
    centroids = spherical_kmeans(sample, cells, id_col, "vec", seed=seed, iterations=6)
    if not len(centroids):
        centroids = np.zeros((1, 1))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, vec {rows.schema['vec'].dataType.simpleString()}, cell int, angle double"
    placed = rows.mapInArrow(_cells(centroids, id_col), schema)
    # a hot cell is split into several tasks and files, small ones share a task
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    radius = np.zeros(len(centroids))
    for r in spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("r")).collect():
        radius[r.cell] = r.r
    spark.createDataFrame([(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(centroids, radius))],
                          "cell int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{path}/cells")
    index = VectorIndex(path, id_col, schema, centroids, radius, len(centroids))
    probes = _calibrated(index, rows, id_col, recall, k, seed) if n else 1
    spark.createDataFrame([(id_col, schema, probes)], "id_col string, schema string, probes int").coalesce(1).write.parquet(f"{path}/index")
    return replace(index, probes=probes)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = sorted(spark.read.parquet(f"{path}/cells").collect())
    meta = spark.read.parquet(f"{path}/index").first()
    return VectorIndex(path, meta.id_col, meta.schema, np.array([c.centroid for c in cells]), np.array([c.radius for c in cells]), meta.probes)


def _calibrated(index: VectorIndex, rows: DataFrame, id_col: str, recall: float, k: int, seed: int) -> int:
    """The smallest number of probes with which the sampled vectors find ``recall`` of their k nearest."""
    q = index.vectors(rows.sparkSession).orderBy(F.xxhash64(id_col, F.lit(seed + 1)), id_col).limit(CALIBRATION)
    q = [(i, r.vec) for i, r in enumerate(q.collect())]
    if not q:
        return 1
    queries = rows.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in q], "query_id long, query_vec array<double>")
    found = search(index, queries, k=k, exact=True, with_cell=True).select("query_id", "cell").collect()
    x = np.array([v for _, v in q], float)
    order = np.argsort(-(x @ index.centroids.T), 1)
    place = np.argsort(order, 1)                       # a cell's turn in the query's order
    needed = np.sort([place[r.query_id, r.cell] + 1 for r in found])
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)]) if len(needed) else 1


def _hits(queries: np.ndarray, wanted: np.ndarray, ks: np.ndarray, qids: list):
    """The best k hits of each query among a task's rows; ``wanted[q, cell]`` says which cells q reads."""
    def cut(part: list[tuple]) -> list[np.ndarray]:
        q, score, ids, cell = (np.concatenate(c) for c in zip(*part))
        order = np.lexsort((ids, -score, q))
        q, score, ids, cell = q[order], score[order], ids[order], cell[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < ks[q]
        return [q[keep], score[keep], ids[keep], cell[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in slices(batches):
            rows, x = matrix(b.column(1))
            ids = b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
            cells = b.column(2).to_numpy()[rows]
            for c in np.unique(cells):
                qs = np.flatnonzero(wanted[:, c])
                mine = np.flatnonzero(cells == c)
                if not len(qs):
                    continue
                s = np.round(x[mine] @ queries[qs].T, SCORE_DIGITS) + 0.0      # no negative zero
                at, of = np.divmod(np.arange(s.size), len(qs))
                part = (qs[of], s.ravel(), ids[mine][at], np.full(s.size, c))
                held.append(tuple(cut([part])))
                size += len(held[-1][0])
            if size > 4 * (int(ks.sum()) + ROWS_HELD):
                held = [tuple(cut(held))]
                size = len(held[0][0])
        if held:
            q, score, ids, cell = cut(held)
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q]), pa.array(ids), pa.array(score), pa.array(cell, pa.int32())],
                                             ["q", "id", "score", "cell"])
    return run


ROWS_HELD = 100_000


def search(index: VectorIndex, queries: DataFrame, k: int | str = 5, probes: int | None = None, exact: bool = False,
           qid: str = "query_id", qvec: str = "query_vec", with_cell: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k vectors nearest to each query by cosine, rounded to
    SCORE_DIGITS, ties to the smaller id.  ``k``: a number or a column of ``queries``.

    Queries are taken in blocks of at most MAX_QUERIES rows, which reach the driver; a block is one
    pass over its cells (two with ``exact``).  Query vectors that are null, zero or not finite and
    queries with k < 1 find nothing."""
    spark = queries.sparkSession
    kc = F.col(k) if isinstance(k, str) else F.lit(k)
    table = queries.select(F.col(qid).alias("q"), F.transform(qvec, lambda x: x.cast("double")).alias("v"), kc.cast("int").alias("k"))
    n = -(-max(1, table.count()) // (MAX_QUERIES // 2))
    stored = index.vectors(spark)
    kinds = f"q {table.schema['q'].dataType.simpleString()}, id {stored.schema[index.id_col].dataType.simpleString()}, score double, cell int"
    out = None
    for part in range(n):
        # a block by the hash of its id: about half of MAX_QUERIES rows, at most all of them
        block = table.where(F.pmod(F.xxhash64("q"), F.lit(n)) == part).collect()
        found = _block(index, stored, block, kinds, probes or index.probes, exact)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    ks = table.select(F.col("q"), "k")
    ranked = out.withColumn("rank", F.row_number().over(w).cast("bigint")).join(ks, "q").where("rank <= k")
    cols = [F.col("q").alias(qid), F.col("id").alias(index.id_col), "score", "rank"]
    return ranked.select(*cols, *(["cell"] if with_cell else []))


def _block(index: VectorIndex, stored: DataFrame, block: list, kinds: str, probes: int, exact: bool) -> DataFrame:
    spark = stored.sparkSession
    dim = index.centroids.shape[1]
    good = [r for r in block if r.v is not None and len(r.v) == dim and None not in r.v and np.all(np.isfinite(r.v)) and any(r.v)
            and r.k is not None and r.k > 0]
    if not good:
        return spark.createDataFrame([], kinds)
    x = np.array([r.v for r in good])
    x /= np.sqrt((x * x).sum(1))[:, None]
    ks, qids = np.array([r.k for r in good]), [r.q for r in good]
    angle = np.arccos(np.clip(x @ index.centroids.T, -1, 1))
    wanted = np.argsort(np.argsort(angle, 1, kind="stable"), 1) < probes

    def read(cells: np.ndarray) -> DataFrame:
        some = [int(c) for c in np.flatnonzero(cells.any(0))]
        # the folders of other cells are not listed as files to read
        rows = stored.where(F.col("cell").isin(some)).select(index.id_col, "vec", "cell")
        return rows.mapInArrow(_hits(x, cells, ks, qids), kinds)
    if not exact or wanted.all():
        return read(wanted)
    first = materialize(read(wanted), "ivf-hits")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id")))
    least = np.full(len(good), -np.inf)
    at = {q: i for i, q in enumerate(qids)}
    limits = spark.createDataFrame([(r.q, r.k) for r in good], f"{kinds.split(',')[0]}, k int")
    for r in best.join(limits, "q").where("rank = k").select("q", "score").collect():
        least[at[r.q]] = r.score
    # the most that a cell can hold: its vectors lie within `radius` of the centroid
    bound = np.cos(np.maximum(0, angle - index.radius[None, :] - 1e-9))
    more = (bound >= least[:, None] - MARGIN) & ~wanted
    return first.unionByName(read(more)) if more.any() else first
