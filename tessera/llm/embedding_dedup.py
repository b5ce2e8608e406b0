"""Embedding near-duplicates by collision counting over sorted projections.

Within a label, vectors are dealt into cells by the signs of a few projections, in several tables
(the number of signs follows the label's size, so a cell holds about CELL vectors at any size; the
number of tables follows from the recall wanted).  Within a cell, m one-dimensional projections are
sorted; around each vector a window is laid in every projection, and the windows that hold another
vector are counted.  Pairs that reach the count, which is calibrated so that a pair at the cosine
threshold falls short with a chance of MISS, are verified by their cosine in double precision.

A cell larger than a block is compared block by block, each pair of blocks a task of its own; tasks
return counts of links and the edges of a spanning forest, never pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import blocked, components, forest, run_starts, runs

COSINE = 0.93
CELL = 1024
PROJECTIONS = 24
WINDOW = 2.0          # half a window, in distances of a pair at the threshold
MISS = 1e-3           # chance to lose a pair at the threshold: in the count, and in the cells
MAX_SIGNS = 20
SEED = 11


def count_needed(m: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold reaches but for a chance of ``miss``: its
    difference, projected on a normal direction, is normal with the pair's distance as deviation."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * p ** k * (1 - p) ** (m - k)
        if below > miss:
            return k
    return m


def tables_needed(signs: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold has met in a cell but for a chance of ``miss``."""
    p = (1 - math.acos(cosine) / math.pi) ** signs
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log(1 - p))


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _vectors(vectors: DataFrame, linkable: bool = True) -> DataFrame:
    """(vec_id, label, dim, vec): rows whose vectors can link, as unit-length doubles in bytes; or
    the other rows, with null vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            col = rb.column(2)
            col = col.cast(pa.list_(pa.float64()))
            flat = col.values.to_numpy(zero_copy_only=False)        # nulls become NaN
            offs = col.offsets.to_numpy()
            null = np.array(col.is_null()) | np.array(rb.column(1).is_null())
            out, at, dim = [], [], []
            for i in np.flatnonzero(~null).tolist():
                v = flat[offs[i]:offs[i + 1]]
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(v).max(initial=0.0)
                    if not (np.isfinite(v).all() and top > 0):
                        null[i] = True
                        continue
                    v = v / top                                     # no overflow in the norm
                    v = v / math.sqrt(float(v @ v))
                out.append(v.tobytes())
                at.append(i)
                dim.append(len(v))
            if not linkable:
                at = np.flatnonzero(null)
                out, dim = [None] * len(at), [0] * len(at)
            at = pa.array(at, pa.int64())
            yield pa.record_batch({"vec_id": rb.column(0).cast(pa.int64()).take(at), "label": rb.column(1).cast(pa.int64()).take(at),
                                   "dim": pa.array(dim, pa.int32()), "vec": pa.array(out, pa.binary())})

    return vectors.select("vec_id", "label", "embedding").mapInArrow(work, "vec_id long, label long, dim int, vec binary")


def _cells(nodes: DataFrame, cosine: float) -> DataFrame:
    """Each node once per table, with its cell there and in all tables."""
    need = [tables_needed(s, cosine) for s in range(MAX_SIGNS + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            t = pa.Table.from_batches([rb])
            dims, signs = t["dim"].to_numpy(), t["signs"].to_numpy()
            for dim in np.unique(dims):
                for k in np.unique(signs[dims == dim]):
                    rows = t.filter(pa.array((dims == dim) & (signs == k))).combine_chunks()
                    x = np.frombuffer(b"".join(rows["vec"].to_pylist()), float).reshape(-1, dim)
                    n, tables = len(x), need[k]
                    cell = np.zeros((n, tables), np.int32)
                    if k:
                        side = x @ _directions(int(dim), tables * int(k), SEED) > 0
                        cell = (side.reshape(n, tables, k) << np.arange(k)).sum(2).astype(np.int32)
                    every = [c.tobytes() for c in cell]
                    for i in range(tables):
                        yield from rows.select(["label", "dim", "node", "copies", "vec"]).append_column(
                            "tab", pa.array(np.full(n, i, np.int32))).append_column("cell", pa.array(cell[:, i])).append_column(
                            "cells", pa.array(every, pa.binary())).to_batches()

    return nodes.mapInArrow(work, "label long, dim int, node long, copies long, vec binary, tab int, cell int, cells binary")


def collisions(proj: np.ndarray, half: float, queries: np.ndarray) -> np.ndarray:
    """(queries, n) counts of the projections in which a row lies in the query's window."""
    n, m = proj.shape
    count = np.zeros((len(queries), n), np.uint8)
    for p in range(m):
        order = np.argsort(proj[:, p], kind="stable")
        ordered = proj[order, p]
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n)
        lo = np.searchsorted(ordered, proj[queries, p] - half, "left").astype(np.int32)
        hi = np.searchsorted(ordered, proj[queries, p] + half, "right").astype(np.int32)
        count += (rank >= lo[:, None]) & (rank < hi[:, None])
    return count


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows with equal, non-null labels and vectors of the same length are linked when their cosine is
    at least ``cosine``.  n_links: other rows linked directly; component_id: smallest vec_id
    reachable; kept: vec_id = component_id.  Equal vectors of a label are one node with a count.
    Null, empty or zero vectors, and those with null or non-finite components, link with nothing,
    like rows without a label: no links, their own component.  A null vec_id has links but no say
    in component_id; kept is false for it.  Other columns are ignored."""
    half = WINDOW * math.sqrt(2 - 2 * cosine)
    need = count_needed()
    good = materialize(_vectors(vectors), "vectors")
    by = good.groupBy("label", "dim", "vec").agg(F.coalesce(F.min("vec_id"), F.lit(1 << 62)).alias("low"), F.count("*").alias("copies"))
    nodes = materialize(by.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    signs = F.greatest(F.lit(0), F.least(F.lit(MAX_SIGNS), F.ceil(F.log2(F.col("n") / F.lit(CELL))).cast("int")))
    cells = materialize(_cells(nodes.join(sizes, ["label", "dim"]).select("label", "dim", "node", "copies", "vec", signs.alias("signs")), cosine), "cells")
    bucket = ["label", "dim", "tab", "cell"]
    keys = [*bucket, "p", "q"]
    pairs = blocked(cells, bucket, "node").repartition(*keys).sortWithinPartitions(*keys)
    names = pairs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs((pa.RecordBatch.from_arrays(b.columns, names) for b in batches), keys, 1):
            cols = [t[k].to_numpy() for k in keys]
            starts = run_starts(cols)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                part = t.slice(s, e - s)
                dim, tab = part["dim"][0].as_py(), part["tab"][0].as_py()
                x = np.frombuffer(b"".join(part["vec"].to_pylist()), float).reshape(-1, dim)
                seen = np.frombuffer(b"".join(part["cells"].to_pylist()), np.int32).reshape(len(x), -1)[:, :tab]
                node, copies, blk = (part[k].to_numpy() for k in ("node", "copies", "blk"))
                own = part["p"][0].as_py() == part["q"][0].as_py()
                first = blk == part["p"][0].as_py()
                proj = (x @ _directions(dim, PROJECTIONS, SEED + 1)).astype(np.float32)
                links = np.zeros(len(x), np.int64)
                left, right = [], []
                rows = np.arange(len(x)) if own else np.flatnonzero(first)
                for lo in range(0, len(rows), 256):
                    q = rows[lo:lo + 256]
                    i, j = np.nonzero(collisions(proj, half, q) >= need)
                    i = q[i]
                    ok = i < j if own else ~first[j]
                    i, j = i[ok], j[ok]
                    ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    i, j = i[ok], j[ok]
                    if tab:      # counted in the first table in which the two meet
                        new = ~(seen[i] == seen[j]).any(1)
                        i, j = i[new], j[new]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    a, b = forest(len(x), i, j)
                    left.append(a)
                    right.append(b)
                a, b = forest(len(x), np.concatenate(left), np.concatenate(right)) if left else ([], [])
                at = np.flatnonzero(links)
                yield pa.record_batch({"a": pa.array(np.concatenate([node[a], node[at]]) if len(at) else np.zeros(0, np.int64)),
                                       "b": pa.array(np.concatenate([node[b], np.full(len(at), -1)]) if len(at) else np.zeros(0, np.int64)),
                                       "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[at]]) if len(at) else np.zeros(0, np.int64))})

    found = materialize(pairs.mapInArrow(work, "a long, b long, links long"), "vector-links")
    comp = components(found.where("b >= 0").select("a", "b"))
    links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labelled = nodes.join(comp, "node", "left").withColumn("c", F.coalesce("component_id", "node"))
    low = labelled.groupBy("c").agg(F.min("low").alias("component"))
    done = labelled.join(low, "c").join(links, "node", "left").select(
        "label", "dim", "vec", F.when(F.col("component") < (1 << 62), F.col("component")).alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # rows with a node, and the input rows that could not link
    rows = good.join(done.hint("shuffle_merge"), ["label", "dim", "vec"]).select("vec_id", "n_links", "component")
    rest = _vectors(vectors, linkable=False).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return rows.unionByName(rest).select(
        "vec_id", "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
