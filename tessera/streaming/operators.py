"""Streaming forms of the transcript operators (ST1-ST7).

The reference polls and prints; here the same rules run as Structured
Streaming queries.  State is bounded by watermarks (ST1, ST7) and by timers
that end silent streams and threads (ST2, ST6).  ST2, ST6 and the append
form of ST7 run Python (``transformWithStateInPandas``), on one group's new
rows per micro-batch; the running forms (ST3, ST5, ST7) run in update mode.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming.state import ChunkAssembler, ReviewCounter, SessionCounter, WindowCounter


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast with the UTC session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_new_messages(polls: DataFrame, thread: str, msg_id: str, delay: str,
                        ts: str = "ts") -> DataFrame:
    """ST1: each (thread, message id) once within ``delay`` of event time; an id
    that comes again later than that is emitted again, and rows later than the
    watermark are dropped, so ``delay`` must cover how long ids recur."""
    return (event_time(polls, ts).filter(F.col(msg_id).isNotNull())
            .withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark([thread, msg_id]))


CHUNK_OUT = "stream_id long, msg_no long, n_chunks long, content string, complete boolean"


def _processed(df: DataFrame, key: str, processor, schema: str, ts: str | None, delay: str) -> DataFrame:
    if ts is None:
        return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "None")
    src = event_time(df, ts).withColumnRenamed(ts, "ts").withWatermark("ts", delay)
    return src.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_assemble_chunks(chunks: DataFrame, ts: str | None = None, delay: str = "1 hour",
                           abandon_ms: int = 3_600_000, abandoned: bool = False) -> DataFrame:
    """ST2: H6 with keyed state.  ``chunks``: (stream_id, seq, content, is_final[, ts]), seq contiguous
    from 1 per stream.  Chunks wait in state, each under its number, until every chunk up to the final
    one has arrived; a batch touches the new chunks and those of messages that it finishes.

    With ``ts`` state is bounded: a stream that is silent for ``abandon_ms`` of event time past its
    latest chunk ends, and ``abandoned`` gives what then waited as rows with ``complete`` false (all
    waiting chunks in order).  A chunk that comes again after its message was given out is ignored."""
    out = _processed(chunks, "stream_id", ChunkAssembler(abandon_ms if ts else None), CHUNK_OUT, ts, delay)
    return out if abandoned else out.where("complete").drop("complete")


def stream_last_message(messages: DataFrame, thread: str = "thread_id", turn: str = "turn") -> DataFrame:
    """ST3: running H1 (latest message per thread), for update mode keyed by the thread."""
    s = F.struct(F.col(turn).alias(turn), F.col("role").alias("role"), F.col("text").alias("text"))
    return (messages.groupBy(thread).agg(F.max_by(s, F.col(turn)).alias("_m"))
            .select(thread, F.col(f"_m.{turn}").alias(turn), F.col("_m.role").alias("role"),
                    F.col("_m.text").alias("text")))


def stream_input_alerts(messages: DataFrame, name: str = "name", pattern: str = "review") -> DataFrame:
    """ST4: stateless alert on messages whose speaker name contains the pattern."""
    nm = F.col(name)
    return messages.filter((F.coalesce(nm, F.lit("")) != "") & F.lower(nm).contains(pattern.lower()))


def stream_run_monitor(run_events: DataFrame, run: str = "run_id") -> DataFrame:
    """ST5: latest status per run, for update mode keyed by the run; ``drain``
    callers route failed runs to a side sink from the same micro-batch."""
    key = F.struct(F.col("ts"), F.col("event_id"))
    return run_events.groupBy(run).agg(F.max_by(F.col("status"), key).alias("status"),
                                       F.max_by(F.col("last_error"), key).alias("last_error"),
                                       F.count(F.lit(1)).cast("bigint").alias("n_events"))


DECISION_OUT = ("thread_id long, turn long, quality double, iteration long, threshold double, approved boolean, "
                "emitted_quality double, decided boolean")


def stream_iteration_decision(messages: DataFrame, ts: str | None = None, delay: str = "1 hour",
                              abandon_ms: int = 3_600_000, undecided: bool = False) -> DataFrame:
    """ST6: L11 with a per-thread review counter.  ``messages``: (thread_id, seq, turn, is_review,
    quality[, ts]) with seq contiguous from 1 per thread.  Messages may arrive in any order; a review
    is decided once every earlier message of its thread has arrived, so its iteration is exact.

    With ``ts`` a thread that is silent for ``abandon_ms`` of event time ends: its counter goes, and
    ``undecided`` gives the reviews that still waited behind a gap as rows with ``decided`` false."""
    out = _processed(messages, "thread_id", ReviewCounter(abandon_ms if ts else None), DECISION_OUT, ts, delay)
    return out if undecided else out.where("decided").drop("decided")


WINDOW_SALTS = 16
SESSION_BUCKETS = 256


def stream_trend_closed(events: DataFrame, group: str, ts: str = "ts", size_ms: int = 86_400_000, slide_ms: int | None = None,
                        session: bool = False, delay: str = "1 day", salts: int = WINDOW_SALTS) -> DataFrame:
    """ST7 in append mode: (group, window_start, window_end, n, late).  A window comes once, when the
    watermark passes its end; rows that come later than that are counted in rows with ``late`` true,
    so the two together are all rows.  ``size_ms`` is the gap of ``session`` windows, which end that
    long after their last row and break where two rows are at least that far apart.

    Rows of a group are dealt by ``salts`` (not those of sessions), so a hot group is no single task;
    a window's parts come in one micro-batch and :func:`combine_windows` adds them up there.  Sessions
    are counted by buckets of groups, of which there are SESSION_BUCKETS."""
    if session:
        return _sessions_closed(events, group, ts, size_ms, delay)
    salt = F.pmod(F.xxhash64(ts), F.lit(salts)).cast("int")
    src = event_time(events, ts).select(F.col(group).alias("grp"), F.col(ts).alias("time"), salt.alias("salt")).withWatermark("time", delay)
    # Spark drops late rows by the column that bears the watermark; the processor is to see them
    src = src.select("grp", "salt", (F.col("time") + F.expr("INTERVAL '0' SECOND")).alias("at"))
    kind = dict(events.dtypes)[group]
    out = src.groupBy("grp", "salt").transformWithStateInPandas(
        WindowCounter(size_ms, slide_ms), f"grp {kind}, window_start timestamp, window_end timestamp, n long, late boolean", "append", "EventTime")
    return out.select(F.col("grp").alias(group), F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", "late")


def _sessions_closed(events: DataFrame, group: str, ts: str, gap_ms: int, delay: str) -> DataFrame:
    kind = dict(events.dtypes)[group]
    src = event_time(events, ts).select(F.col(group).cast("string").alias("grp"), F.col(ts).alias("time"),
                                        F.pmod(F.xxhash64(group), F.lit(SESSION_BUCKETS)).cast("int").alias("bucket"))
    src = src.withWatermark("time", delay).select("grp", "bucket", (F.col("time") + F.expr("INTERVAL '0' SECOND")).alias("at"))
    out = src.groupBy("bucket").transformWithStateInPandas(
        SessionCounter(gap_ms), "grp string, window_start timestamp, window_end timestamp, n long, late boolean", "append", "EventTime")
    return out.select(F.col("grp").cast(kind).alias(group), F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", "late")


def combine_windows(batch: DataFrame) -> DataFrame:
    """One row for each window of a micro-batch."""
    keys = [c for c in batch.columns if c != "n"]
    return batch.groupBy(*keys).agg(F.sum("n").alias("n")).select(*batch.columns)


def stream_trend(events: DataFrame, group: str, ts: str = "ts", size: str = "1 day",
                 slide: str | None = None, session_gap: str | None = None,
                 delay: str = "1 day") -> DataFrame:
    """ST7: counts per group in tumbling, sliding or session windows under a
    watermark.  Window bounds come back as TIMESTAMP_NTZ (UTC wall time)."""
    e = event_time(events, ts).withWatermark(ts, delay)
    if session_gap is not None:
        w = F.session_window(F.col(ts), session_gap)
    elif slide is not None:
        w = F.window(F.col(ts), size, slide)
    else:
        w = F.window(F.col(ts), size)
    return (e.groupBy(F.col(group), w.alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .select(group, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n"))
