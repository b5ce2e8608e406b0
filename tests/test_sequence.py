"""Skew-safe ordered helpers equal plain windows, also when keys span many buckets."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import sequence as sq


def _data(spark):
    # key 0 is hot (most rows); ties on ts broken by id; one key is null
    return spark.range(0, 600).select(
        F.when(F.col("id") % 5 == 0, F.nullif(F.col("id") % 3 + 1, F.lit(3))).otherwise(F.lit(0)).alias("k"),
        (F.col("id") % 97).alias("ts"), F.col("id").alias("id"), (F.col("id") % 4).alias("v"))


@pytest.mark.parametrize("n", [None, 1, 23])
def test_sequence_number_matches_window(spark, n):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r.id: r.rn for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert {r.id: r.seq for r in sq.sequence_number(df, ["k"], ["ts", "id"], n_buckets=n).collect()} == want
    assert sq.sequence_number(df.limit(0), ["k"], ["ts", "id"], n_buckets=n).count() == 0


def test_running_sum_and_max_match_window(spark):
    df = _data(spark).withColumn("m", F.when(F.col("v") > 1, F.col("id")))
    w = Window.partitionBy("k").orderBy("ts", "id")
    ex = w.rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: (r.s, r.mx) for r in df.select(
        "id", F.coalesce(F.sum("v").over(ex), F.lit(0)).alias("s"), F.max("m").over(ex).alias("mx")).collect()}
    rs = sq.running_sum(df, ["k"], ["ts", "id"], "v", "s", inclusive=False, n_buckets=31)
    rm = sq.running_max(rs, ["k"], ["ts", "id"], "m", "mx", inclusive=False, n_buckets=17)
    assert {r.id: (r.s, r.mx) for r in rm.collect()} == want


def test_next_row_matches_window(spark):
    df = _data(spark).withColumn("x", F.nullif(F.col("v"), F.lit(2)))
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r.id: (r.nx, r.h) for r in df.select(
        "id", F.lead("x").over(w).alias("nx"), F.lead("id").over(w).isNotNull().alias("h")).collect()}
    got = sq.with_next_row(df, ["k"], ["ts", "id"], ["x"], n_buckets=29).collect()
    assert {r.id: (r.next_x, r.has_next) for r in got} == want


@pytest.mark.parametrize("ts", ["CAST(7 AS BIGINT)", "CASE WHEN id = 0 THEN 1000000000 ELSE id % 5 END"])
def test_buckets_of_a_hot_key_hold_equal_counts(spark, ts):
    # one timestamp for all rows; values within five units and one outlier
    df = spark.range(0, 5000).select(F.lit(1).alias("k"), F.expr(ts).alias("ts"), "id")
    sizes = [r["count"] for r in sq.bucketed(df, ["k"], ["ts", "id"], n_buckets=50).groupBy("_b").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 2 * 5000 / 50


def test_previous(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, x string")
    p = {(r.k, r.seq): r.prev_x for r in sq.with_previous(df, ["k"], "seq", ["x"]).collect()}
    assert p == {(1, 1): None, (1, 2): "a", (2, 1): None}
