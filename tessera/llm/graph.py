"""Connected components and blocked linking inside buckets, without collecting a group.

``components`` is the alternating large-star / small-star scheme on DataFrames.  ``bucket_links``
compares the members of each bucket in numpy, in blocks of bounded size, and returns only the edges
of a spanning forest, so a bucket of n members never emits its n * n pairs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# members of one block; a task holds at most two blocks of one bucket
BLOCK = 2048


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) for every node of an undirected edge list of longs; component_id is
    the smallest node reachable.  Self loops and null ends are ignored; no edges give no rows.

    Each round is two joins and two partial aggregates; the edges are written to the shared
    checkpoint folder after each round, so a lost executor costs one round at most.  Ends when a
    round changes nothing (rounds grow with the logarithm of the longest chain)."""
    e = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
         .where("a is not null and b is not null and a != b").distinct())
    e = materialize(e, "cc")
    seen = _checksum(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                        .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())


def blocked(rows: DataFrame, bucket: list[str], spread: str, block: int = BLOCK) -> DataFrame:
    """Rows of the buckets with two or more members, each repeated once per pair of blocks it
    takes part in: adds ``blk`` (its own block), ``p`` and ``q`` (the pair, p <= q).

    A bucket of n members has ceil(n / block) blocks, chosen by the hash of ``spread``."""
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1")
    r = rows.join(sizes, bucket).withColumn("_b", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    r = r.withColumn("blk", F.pmod(F.xxhash64(spread), F.col("_b")).cast("int"))
    r = r.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return (r.withColumn("p", F.least("blk", "_o")).withColumn("q", F.greatest("blk", "_o"))
            .drop("_n", "_b", "_o"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables that never cut a run of equal ``keys``."""
    held: list[pa.Table] = []
    rows = 0
    for rb in batches:
        if rb.num_rows:
            held.append(pa.Table.from_batches([rb]))
            rows += rb.num_rows
        if rows < least_rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        cut = run_starts([t[k].to_numpy() for k in keys])[-1]
        if cut:
            yield t.slice(0, cut)
        held, rows = [t.slice(cut)], t.num_rows - cut
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def run_starts(cols: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member of its part) that connect what the given edges connect."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def rounds(rows: np.ndarray, others: np.ndarray, same: bool, pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two blocks (or within one), some rows against all others at a time: few rows
    first, so that what is much alike is connected early."""
    k, step = 0, 8
    while k < len(rows):
        part = rows[k:k + step]
        i, j = np.repeat(part, len(others)), np.tile(others, len(part))
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j
        k += step
        step = min(2 * step, max(8, pairs // max(1, len(others))))


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each part) after the edges i-j are added."""
    while len(i):
        a, b = label[i], label[j]
        new = a != b
        if not new.any():
            break
        i, j = i[new], j[new]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(a, b)[new], np.minimum(a, b)[new])
        while not np.array_equal(hop := root[root], root):
            root = hop
        label = root[label]
    return label


def apart(n: int, left: list, right: list, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose ends the edges so far do not connect (and the edges, made a forest)."""
    label = np.arange(n)
    a, b = forest(n, np.concatenate(left), np.concatenate(right))
    left[:], right[:] = [a], [b]
    label[a] = b
    ok = label[i] != label[j]
    return i[ok], j[ok]


def bucket_links(rows: DataFrame, bucket: list[str], node: str, payload: list[str],
                 link: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray],
                 block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between nodes (longs) of one bucket for which ``link`` holds, as a spanning
    forest of each block pair.

    ``link(cols, i, j)`` gets the columns of a run of rows and index arrays, and returns a mask."""
    keys = [*bucket, "p", "q"]
    r = blocked(rows.select(*bucket, node, *payload), bucket, node, block)
    # one copy per pair; the pair's own task sees its two blocks only
    r = r.select(*keys, "blk", node, *payload).repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            cols = {c: t[c].to_numpy() for c in t.column_names}
            starts = run_starts([cols[k] for k in keys])
            ends = np.append(starts[1:], t.num_rows)
            size = ends - starts
            group = np.repeat(np.arange(len(starts)), size)
            own_pair = cols["p"] == cols["q"]
            left, right = [], []
            # small runs: shift by d and compare, all runs at once
            small = np.flatnonzero(np.repeat(size <= 64, size))
            d = 1
            while d <= 64:
                j = small + d
                ok = j < t.num_rows
                i, j = small[ok], j[ok]
                ok = group[i] == group[j]
                if not ok.any():
                    break
                i, j = i[ok], j[ok]
                small = i
                ok = own_pair[i] | (cols["blk"][i] != cols["blk"][j])
                i, j = i[ok], j[ok]
                ok = link(cols, i, j)
                left.append(i[ok])
                right.append(j[ok])
                d += 1
            # large runs: row by row blocks against the rest
            for s, e in zip(starts[size > 64], ends[size > 64]):
                at = np.arange(s, e)
                if own_pair[s]:
                    sides = (at, at)
                else:
                    first = cols["blk"][at] == cols["p"][s]
                    sides = (at[first], at[~first])
                for i, j in rounds(*sides, own_pair[s]):
                    # what earlier rounds connect needs no comparison
                    if left:
                        i, j = apart(t.num_rows, left, right, i, j)
                    ok = link(cols, i, j)
                    left.append(i[ok])
                    right.append(j[ok])
            if left:
                a, b = forest(t.num_rows, np.concatenate(left), np.concatenate(right))
                yield pa.record_batch({"a": pa.array(cols[node][a], pa.int64()),
                                       "b": pa.array(cols[node][b], pa.int64())})

    return r.mapInArrow(work, "a long, b long")
