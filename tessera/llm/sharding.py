"""Sharding by minimax contiguous partition, in DataFrame operations only.

Rows with equal texts are one atomic group.  Groups are ordered, and the order is cut into
contiguous shards whose largest is as small as it can be: the smallest feasible capacity is found
by a search that checks capacities greedily (fill a shard up to the capacity, cut, go on), and the
cuts of that capacity are the shards.

The driver holds byte totals of a fixed number of key ranges, at most one cut per shard, and the
groups that are larger than a whole fair share (fewer than there are shards).
"""
from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

RANGE_BITS = 12      # key ranges whose totals the driver holds: 2 ** RANGE_BITS
CANDIDATES = 1023    # capacities checked side by side in one round of the search
SLOT_ROWS = 50_000   # rows numbered in one task, about

_KEY = ("k", "text_crc32", "size")


def _is(g) -> Column:
    c = F.lit(True)
    for x in _KEY:
        c = c & (F.col(x) == F.lit(g[x]))
    return c


def _values(spark, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of whole numbers, known to the driver (no job)."""
    body = ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows) or "(" + ", ".join("0L" for _ in names) + ")"
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def _greedy_over_ranges(ends: list[int], shards: int, capacity: int) -> bool:
    """Feasible with cuts at range ends only."""
    at = 0
    for _ in range(shards):
        i = bisect.bisect_right(ends, at + capacity) - 1
        if i < 0 or ends[i] <= at:
            return at >= ends[-1]
        at = ends[i]
    return at >= ends[-1]


class _Order:
    """The ordered groups with their running byte totals, written once."""

    def __init__(self, groups: DataFrame):
        rng = F.shiftright("k", 64 - RANGE_BITS) + F.lit(1 << (RANGE_BITS - 1))
        groups = materialize(groups.withColumn("range", rng), "shard-groups")
        totals = {r["range"]: r["b"] for r in groups.groupBy("range").agg(F.sum("bytes").alias("b")).collect()}
        self.ranges = sorted(totals)
        self.begin, at = [], 0
        for r in self.ranges:
            self.begin.append(at)
            at += totals[r]
        self.total = at
        self.ends = [*self.begin[1:], at] if self.ranges else []
        self.spark = groups.sparkSession
        starts = _values(self.spark, list(zip(self.ranges, self.begin)), "range", "begin")
        w = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)
        # 2 ** RANGE_BITS rows at most
        self.rows = materialize(
            groups.join(F.broadcast(starts), "range").withColumn("cum", F.col("begin") + F.sum("bytes").over(w))
            .drop("begin"), "shard-order")

    def reach(self, targets: list[int]) -> list[int]:
        """For each target the largest group end that does not exceed it (0: none)."""
        out = [0] * len(targets)
        ask = []
        for i, t in enumerate(targets):
            if t >= self.total:
                out[i] = self.total
                continue
            j = bisect.bisect_right(self.begin, t) - 1
            out[i] = self.begin[j]
            ask.append((i, self.ranges[j], int(t)))
        if ask:
            # CANDIDATES rows at most
            q = F.broadcast(_values(self.spark, ask, "i", "range", "target"))
            near = self.rows.where(F.col("range").between(min(a[1] for a in ask), max(a[1] for a in ask)))
            for r in (near.join(q, "range").where("cum <= target").groupBy("i").agg(F.max("cum").alias("c")).collect()):
                out[r["i"]] = max(out[r["i"]], r["c"])
        return out

    def feasible(self, shards: int, capacities: list[int]) -> int:
        """Index of the first of the rising capacities that needs no more than ``shards`` shards."""
        at = [0] * len(capacities)
        for left in range(shards, 0, -1):
            done = [self.total - a <= c for a, c in zip(at, capacities)]
            if done[0] or left == 1:
                return done.index(True) if True in done else len(capacities)
            # feasibility is monotone: only the capacities below the first that is done are open
            n = done.index(True) if True in done else len(capacities)
            at[:n] = self.reach([a + c for a, c in zip(at[:n], capacities[:n])])
        return len(capacities)

    def cuts(self, shards: int, capacity: int) -> list[int]:
        out, at = [], 0
        while self.total - at > capacity and len(out) < shards - 1:
            at = self.reach([at + capacity])[0]
            out.append(at)
        return out


def smallest_capacity(order: _Order, shards: int, largest: int) -> int:
    low = max(largest, -(-order.total // shards))
    a, b = low, max(low, order.total)
    while a < b:                       # an upper bound from the driver's totals alone
        m = (a + b) // 2
        if _greedy_over_ranges(order.ends, shards, m):
            b = m
        else:
            a = m + 1
    high = b
    while low < high:                  # the answer is in low..high; high is feasible
        n = min(CANDIDATES, high - low)
        tries = sorted({low + (high - low) * i // n for i in range(n)})
        i = order.feasible(shards, tries)
        high, low = (tries[i] if i < len(tries) else high), (tries[i - 1] + 1 if i else low)
    return high


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs``.

    size: UTF-8 bytes of the text and 8 (null: 8); rows with equal texts (64-bit hash, CRC-32 and
    length agree; null counts as empty) share a shard.  Groups larger than a fair share of what is
    left come first, each a shard of its own; the others follow in the order of their text hash,
    cut by the minimax capacity.  slot numbers the rows of a shard without gaps from 0.  Null or
    repeated doc_ids and other columns do not matter; with fewer groups than shards some shards stay
    empty; an empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"),
        F.monotonically_increasing_id().alias("m")), "shard-rows")
    groups = materialize(rows.groupBy(*_KEY).agg((F.count("*") * F.col("size")).alias("bytes"), F.count("*").alias("n")), "shard-sizes")
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    if not n_rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    giants, left = [], shards
    for g in groups.orderBy(F.desc("bytes"), *_KEY).limit(shards - 1).collect():   # at most shards - 1 rows
        if g["bytes"] * left < total:
            break
        giants.append(g)
        total -= g["bytes"]
        left -= 1
    others = groups
    for g in giants:
        others = others.where(~_is(g))
    order = _Order(others)
    number = F.lit(len(giants))
    if order.total:
        largest = order.rows.agg(F.max("bytes")).first()[0]
        cuts = order.cuts(left, smallest_capacity(order, left, largest))
        key = F.struct(*_KEY)
        for c in order.rows.where(F.col("cum").isin(cuts)).select(*_KEY).collect() if cuts else []:
            number = number + (key > F.struct(*[F.lit(c[x]).cast("long") for x in ("k", "text_crc32", "size")])).cast("int")
    for i, g in enumerate(giants):
        number = F.when(_is(g), i).otherwise(number)
    parts = max(16, math.ceil(n_rows / SLOT_ROWS))
    placed = rows.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), F.col("k"), F.col("m"),
                         F.pmod(F.xxhash64("m"), F.lit(parts)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = counts.select("shard", "part", (F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("m")) - 1
    return (placed.withColumn("at", at).join(before, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot")))
