"""Streams that are stopped and started again: state, timers, keyed sinks, closed windows, the thread log."""
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import log as tl
from tessera.streaming import operators as so
from tessera.streaming.runner import STATE_STORE, drain, read_stream, replay, side_path, stage
from tessera.streaming.upsert import UpsertTable

T0 = datetime(2024, 1, 1)


def add(df, path):
    df.write.mode("append").parquet(path)


def waiting(spark, at, name="wait"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark.read.format("statestore").option("path", f"{at}/checkpoint").option("stateVarName", name).load().count()


CHUNKS = "stream_id long, seq long, content string, is_final boolean, ts timestamp"


def chunk(stream, seq, final, minutes):
    return (stream, seq, f"{stream}.{seq} ", final, T0 + timedelta(minutes=minutes))


def test_chunks_over_restarts_leave_no_state(spark, tmp_path):
    """Chunks shuffled over five runs of one query: whole messages once each, nothing left in state."""
    r = random.Random(1)
    rows = [chunk(s, q, q % 4 == 0, 0) for s in range(6) for q in range(1, 21)]
    r.shuffle(rows)
    path, at = str(tmp_path / "in"), str(tmp_path / "at")
    for i in range(5):
        # some chunks come twice
        add(spark.createDataFrame(rows[i::5] + rows[:i], CHUNKS), path)
        out = drain(so.stream_assemble_chunks(read_stream(spark, path, CHUNKS), ts="ts", delay="1 day"), "t", at=at)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((s, m + 1, 4, "".join(f"{s}.{q} " for q in range(4 * m + 1, 4 * m + 5))) for s in range(6) for m in range(5))
    assert waiting(spark, at) == 0 and waiting(spark, at, "place") == 6


def test_silent_streams_end_and_say_so(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "at")
    steps = [[chunk(1, 1, False, 0), chunk(1, 3, True, 1), chunk(2, 1, True, 2), chunk(3, 1, False, 3)],
             [chunk(3, 2, True, 50), chunk(4, 1, True, 300)],
             [chunk(4, 2, True, 301), chunk(1, 2, False, 302)],
             [chunk(5, 1, True, 900)]]
    for rows in steps:
        add(spark.createDataFrame(rows, CHUNKS).coalesce(1), path)
        s = so.stream_assemble_chunks(read_stream(spark, path, CHUNKS), ts="ts", delay="10 minutes", abandon_ms=3_600_000, abandoned=True)
        out = drain(s, "t", at=at)
    got = {(r.stream_id, r.content, r.complete) for r in out.collect()}
    assert got == {(2, "2.1 ", True), (3, "3.1 3.2 ", True), (4, "4.1 ", True), (4, "4.2 ", True), (5, "5.1 ", True),
                   # stream 1 waited for its second chunk, which came after the stream had ended
                   (1, "1.1 1.3 ", False), (1, "1.2 ", False)}
    assert waiting(spark, at) == 0 and waiting(spark, at, "place") == 1


def test_reviews_behind_a_gap(spark, tmp_path):
    schema = "thread_id long, seq long, turn long, is_review boolean, quality double, ts timestamp"
    at_ = lambda m: T0 + timedelta(minutes=m)
    steps = [[(1, 2, 2, True, 0.9, at_(0)), (2, 1, 1, True, 0.5, at_(0)), (2, 3, 3, True, None, at_(1))],
             [(1, 1, 1, False, None, at_(5)), (3, 1, 1, True, 0.8, at_(400))], [(3, 2, 2, True, 0.2, at_(900))]]
    path, at = str(tmp_path / "in"), str(tmp_path / "at")
    for rows in steps:
        add(spark.createDataFrame(rows, schema).coalesce(1), path)
        s = so.stream_iteration_decision(read_stream(spark, path, schema), ts="ts", delay="10 minutes", undecided=True)
        out = drain(s, "t", at=at)
    got = {(r.thread_id, r.turn, r.iteration, r.decided) for r in out.collect()}
    assert got == {(1, 2, 1, True), (2, 1, 1, True), (2, 3, None, False), (3, 1, 1, True), (3, 2, 2, True)}
    assert waiting(spark, at) == 0


def test_many_files_are_few_batches(spark, tmp_path):
    df = spark.range(6400).select(F.col("id").alias("thread_id"), F.lit(1).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    path, at = str(tmp_path / "in"), str(tmp_path / "at")
    df.repartition(64).write.parquet(path)
    out = drain(so.stream_input_alerts(read_stream(spark, path, df.schema).withColumn("name", F.lit("reviewer"))), "t", at=at)
    assert out.count() == 6400
    assert len(list((tmp_path / "at" / "sink").glob("epoch=*"))) < 4
    assert stage(df, "t", n_steps=3, order="thread_id")


def test_upsert_table(spark, tmp_path):
    schema = "k long, v string"
    t = UpsertTable(spark, str(tmp_path / "t"), ["k"], schema, least_rows=50)
    assert t.read().count() == 0
    want, changed, r = {}, 0, random.Random(3)
    for epoch in range(30):
        rows = {r.randrange(400): f"{epoch}.{i}" for i in range(20)}
        want |= rows
        changed += len(rows)
        t.write(spark.createDataFrame(list(rows.items()), schema).coalesce(1), epoch)
        if epoch % 7 == 3:
            # the epoch runs again, as after a failure
            t.write(spark.createDataFrame(list(rows.items()), schema).coalesce(1), epoch)
    assert {x.k: x.v for x in t.read().collect()} == want
    # a constant factor of the changes, far below epochs x table
    assert t.rows_written() <= 4 * changed < 30 * len(want) / 2
    again = UpsertTable(spark, str(tmp_path / "t"), ["k"], schema)
    assert {x.k: x.v for x in again.read().collect()} == want


def test_half_written_epoch_is_not_read(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "t"), ["k"], "k long, v string")
    t.write(spark.createDataFrame([(1, "a")], "k long, v string"), 0)
    spark.createDataFrame([(1, "b")], "k long, v string").write.parquet(str(tmp_path / "t/delta/epoch=1"))
    assert [tuple(x) for x in t.read().collect()] == [(1, "a")]


def test_update_mode_writes_changes_only(spark):
    runs = [(i, T0 + timedelta(minutes=s), s * 1000 + i, "failed" if i == 3 and s == 1 else "in_progress", "boom" if i == 3 else None)
            for s in range(4) for i in range(200 if s == 0 else 5)]
    df = spark.createDataFrame(runs, "run_id long, ts timestamp, event_id long, status string, last_error string")
    failed = side_path(spark, "t-failed")
    out = replay(df, "t", so.stream_run_monitor, scatter=F.minute("ts"), mode="update", keys=["run_id"], side=(failed, F.col("status") == "failed"))
    got = {r.run_id: (r.status, r.n_events) for r in out.collect()}
    assert got == {i: ("in_progress", 4 if i < 5 else 1) for i in range(200)}
    assert [(r.run_id, r.last_error) for r in spark.read.parquet(failed).collect()] == [(3, "boom")]


@pytest.mark.parametrize("size,slide", [(3_600_000, None), (7_200_000, 3_600_000), (5_400_000, 3_600_000)])
def test_closed_windows_and_late_rows_are_all_rows(spark, size, slide):
    r = random.Random(size)
    rows = [(r.choice("ab"), T0 + timedelta(minutes=r.randrange(0, 1440)), int(r.random() < 0.2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "grp string, ts timestamp, tardy int")
    out = replay(df, "t", lambda s: so.stream_trend_closed(s, "grp", size_ms=size, slide_ms=slide, delay="2 hours", salts=3),
                 n_steps=2, scatter=F.col("tardy"), combine=so.combine_windows)
    got = {(x.grp, x.window_start, x.late): x.n for x in out.collect()}
    want, step, width = Counter(), timedelta(milliseconds=slide or size), timedelta(milliseconds=size)
    first = max(t for _, t, tardy in rows if not tardy) - timedelta(hours=2)
    last = max(t for _, t, _ in rows) - timedelta(hours=2)
    for g, t, tardy in rows:
        start = T0 + (t - T0) // step * step
        while start + width > t:
            if tardy and start + width <= first:
                want[g, start, True] += 1
            elif start + width <= last:
                want[g, start, False] += 1
            start -= step
    assert got == dict(want) and any(late for _, _, late in got)


def test_thread_log_gives_each_message_once(spark, tmp_path):
    schema = "thread_id long, turn long, text string"
    path, at = str(tmp_path / "log"), str(tmp_path / "at")
    rows = [(t, n, f"{t}.{n}") for t in range(40) for n in range(5)]
    for i in range(4):
        tl.append(spark.createDataFrame(rows[i::4], schema), path, "thread_id", "turn", n_ranges=3)
        if i != 1:                       # the second part waits for the next run
            out = drain(tl.read_log(spark, path, schema), "t", at=at)
            assert out.count() == len(set().union(*(rows[j::4] for j in range(i + 1))))
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    # a part that its writer has not finished is not read
    spark.createDataFrame([(99, 1, "x")], schema).write.parquet(f"{path}/part=4")
    (tmp_path / "log" / "part=4" / "_SUCCESS").unlink()
    assert drain(tl.read_log(spark, path, schema), "t", at=at).count() == len(rows)
    assert len(tl._Reader(path, spark.createDataFrame([], schema).schema).partitions({"parts": 0}, {"parts": 2})) == 6


def test_complete_mode_goes_on(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "at")
    for n in (1, 2):
        add(spark.createDataFrame([(1, T0)] * n, "g long, ts timestamp"), path)
        out = drain(so.stream_trend(read_stream(spark, path, "g long, ts timestamp"), "g"), "t", mode="complete", at=at)
        assert [r.n for r in out.collect()] == [n * (n + 1) // 2]
    with pytest.raises(ValueError):
        drain(read_stream(spark, path, "g long, ts timestamp"), "t", mode="update")


def test_waiting_chunks_lie_in_blocks(spark, tmp_path):
    """The store holds an entry for many waiting chunks, not one for each; content comes back as it was."""
    rows = [(s, q, None if q == 7 else f"{s}.{q} \"é\\ ", q in (150, 300), T0) for s in range(3) for q in range(1, 301)]
    path, at = str(tmp_path / "in"), str(tmp_path / "at")
    add(spark.createDataFrame([x for x in rows if x[1] % 2 == 0], CHUNKS), path)
    drain(so.stream_assemble_chunks(read_stream(spark, path, CHUNKS), ts="ts", delay="1 day"), "t", at=at)
    assert 0 < waiting(spark, at) <= 3 * 3
    add(spark.createDataFrame([x for x in rows if x[1] % 2], CHUNKS), path)
    out = drain(so.stream_assemble_chunks(read_stream(spark, path, CHUNKS), ts="ts", delay="1 day"), "t", at=at)
    want = [(s, m + 1, 150, "".join(x[2] or "" for x in rows if x[0] == s and 150 * m < x[1] <= 150 * m + 150)) for s in range(3) for m in range(2)]
    assert sorted(map(tuple, out.collect())) == want and waiting(spark, at) == 0
