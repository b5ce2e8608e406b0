"""Skew-safe ordered operations within a key (row number, running sum/max,
next row).

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key
into one task; a single hot key (a third of all events for one user, one
huge thread) then becomes one giant sort.  These helpers cut the rows into
order-contiguous *buckets* instead, at every size alike:

1. the rows are range-partitioned by the keys and the whole order, tiebreak
   included, so the buckets hold about the same number of rows whatever the
   values are (ties, bursts, outliers).  The bucket is the range's number; it
   is written with the row, so a recomputation after an executor loss cannot
   renumber anything;
2. the window runs per (key, bucket);
3. a carry table (one row per key and bucket) gives each bucket the count /
   sum / max of the earlier buckets of its key, or the first row of the next
   one, joined back on (key, bucket).  Only keys that span several buckets
   have more than one row there, at most the number of buckets.

A unique order is the caller's part: rows that tie in it are in any order.
The number of buckets is ``spark.sql.shuffle.partitions`` (before AQE merges
small ones) unless ``n_buckets`` is given.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(df: DataFrame, keys, order, n_buckets: int | None = None) -> DataFrame:
    """``df`` with its bucket ``_b``: ranges of (keys, order) of about equal row counts."""
    from tessera.session import materialize
    cols = [*keys, *order]
    ranged = df.repartitionByRange(n_buckets, *cols) if n_buckets else df.repartitionByRange(*cols)
    return materialize(ranged.withColumn("_b", F.spark_partition_id()), "ordered")


def _join_keys(left: DataFrame, right: DataFrame, keys, extra=()) -> DataFrame:
    names = list(keys) + list(extra)
    cond = [left[k].eqNullSafe(right[k]) for k in names]
    cols = [right[c] for c in right.columns if c not in names]
    return left.join(right, cond, "inner").select(left["*"], *cols)


def _local(keys, order, hi: int = 0):
    return Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)


def _earlier(keys):
    return Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sequence_number(df: DataFrame, keys, order, out: str = "seq", n_buckets: int | None = None) -> DataFrame:
    """1-based position of each row within its key by ``order`` (which must
    end in a unique tiebreak)."""
    t = bucketed(df, keys, order, n_buckets)
    t = t.withColumn("_lrn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    cnt = t.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    carry = cnt.select(*keys, "_b", F.coalesce(F.sum("_cnt").over(_earlier(keys)), F.lit(0)).alias("_off"))
    return (_join_keys(t, carry, keys, ["_b"])
            .withColumn(out, (F.col("_off") + F.col("_lrn")).cast("bigint"))
            .drop("_b", "_lrn", "_off"))


def running_sum(df: DataFrame, keys, order, value: str | Column, out: str, inclusive: bool = True,
                n_buckets: int | None = None) -> DataFrame:
    """Running sum of ``value`` within each key in ``order`` (inclusive of the
    current row, or of the preceding rows only); 0 when nothing precedes."""
    t = bucketed(df, keys, order, n_buckets)
    local = _local(keys, order, 0 if inclusive else -1)
    tot = t.groupBy(*keys, "_b").agg(F.sum(_col(value)).alias("_tot"))
    t = t.withColumn("_lsum", F.coalesce(F.sum(_col(value)).over(local), F.lit(0)))
    carry = tot.select(*keys, "_b", F.coalesce(F.sum("_tot").over(_earlier(keys)), F.lit(0)).alias("_carry"))
    return (_join_keys(t, carry, keys, ["_b"])
            .withColumn(out, F.col("_carry") + F.col("_lsum"))
            .drop("_b", "_lsum", "_carry"))


def running_max(df: DataFrame, keys, order, value: str | Column, out: str, inclusive: bool = True,
                n_buckets: int | None = None) -> DataFrame:
    """Running max of ``value`` (nulls ignored) within each key; null when no
    earlier value exists.  With ``value`` a struct of the order and a payload
    (null where the payload is), it is the "last non-null before" lookup."""
    t = bucketed(df, keys, order, n_buckets)
    local = _local(keys, order, 0 if inclusive else -1)
    tot = t.groupBy(*keys, "_b").agg(F.max(_col(value)).alias("_tot"))
    t = t.withColumn("_lmax", F.max(_col(value)).over(local))
    carry = tot.select(*keys, "_b", F.max("_tot").over(_earlier(keys)).alias("_carry"))
    return (_join_keys(t, carry, keys, ["_b"])
            .withColumn(out, F.greatest(F.col("_carry"), F.col("_lmax")))
            .drop("_b", "_lmax", "_carry"))


def with_next_row(df: DataFrame, keys, order, cols, prefix: str = "next_", n_buckets: int | None = None) -> DataFrame:
    """Attach the next row's ``cols`` within each key by ``order``, and
    ``has_next``.  The last row of a bucket takes the first row of the key's
    next bucket from the carry table, so no row is joined with another."""
    t = bucketed(df, keys, order, n_buckets)
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    first = t.groupBy(*keys, "_b").agg(F.min_by(row, F.struct(*order)).alias("_first"))
    carry = first.select(*keys, "_b", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    t = t.withColumn("_next", F.lead(row).over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    nxt = F.coalesce(F.col("_next"), F.col("_carry"))
    return (_join_keys(t, carry, keys, ["_b"])
            .withColumn("_next", nxt)
            .withColumn("has_next", F.col("_next").isNotNull())
            .select("*", *[F.col(f"_next.{c}").alias(prefix + c) for c in cols])
            .drop("_b", "_next", "_carry"))


def with_previous(df: DataFrame, keys, seq: str, cols, prefix: str = "prev_") -> DataFrame:
    """Attach the previous row's ``cols`` (by ``seq``) within each key: an
    equi-join on (key, seq), which is unique for every row."""
    prev = df.select(*keys, (F.col(seq) + 1).alias(seq), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(prev, [*keys, seq], "left")
