"""Registered queries: Structured Streaming operators (ST1-ST7, S5).

Each query gives rows that Spark derives from a driver table to a stream in
steps; after each step the stream is started from its checkpoint and drained
(a step's files are one micro-batch), and the sink is returned.  The oracles
are the batch semantics of the same operator.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequence as sq
from tessera.plans.catalog import register
from tessera.functions.text import TOKEN_PATTERN
from tessera.plans.q_transcripts import _DECISION_SQL, _POLL_ID
from tessera.sources.tables import load
from tessera.streaming import operators as so
from tessera.streaming import log as tl
from tessera.streaming.runner import _path, _steps, drain, replay, side_path


@register("stream_new_messages", f"""SELECT DISTINCT user_id, msg_id FROM (
  SELECT user_id, {_POLL_ID} AS msg_id FROM events) WHERE msg_id IS NOT NULL""")
def q_stream_new_messages(spark, d):
    """ST1: polls replayed in time order; each (user, message id) once."""
    polls = load(spark, d, "events").select(
        "user_id", "event_id", "ts",
        F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10).cast("bigint")).alias("msg_id"))
    return replay(polls, "st1", lambda src: so.stream_new_messages(src, "user_id", "msg_id", "31 days").select("user_id", "msg_id"), order="ts")


@register("stream_assemble_chunks", """SELECT user_id AS stream_id, msg_no, CAST(count(*) AS BIGINT) AS n_chunks,
  string_agg(event_type, '' ORDER BY ts, event_id) AS content FROM (
  SELECT user_id, ts, event_id, event_type, event_type = 'purchase' AS fin,
    CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
      ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS msg_no
  FROM events) GROUP BY user_id, msg_no HAVING bool_or(fin)""")
def q_stream_assemble_chunks(spark, d):
    """ST2: event chunks replayed out of order (hash-split by seq); messages
    are emitted once complete."""
    e = load(spark, d, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id",
                                        F.col("event_type").alias("content"),
                                        (F.col("event_type") == "purchase").alias("is_final"))
    chunks = sq.sequence_number(e, ["stream_id"], ["ts", "event_id"], out="seq").select(
        "stream_id", "seq", "content", "is_final", "ts")
    # watermark far behind the data span: out-of-order chunks are never late
    return replay(chunks, "st2", lambda src: so.stream_assemble_chunks(src, ts="ts", delay="31 days", abandon_ms=31 * 86_400_000),
                  scatter=F.col("seq"))


@register("stream_last_message", """SELECT conv_id AS thread_id, max(turn) AS turn, arg_max(role, turn) AS role,
  arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""")
def q_stream_last_message(spark, d):
    """ST3: running last message per thread (messages replayed by turn)."""
    m = load(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", "text")
    return replay(m, "st3", so.stream_last_message, order="turn", mode="update", keys=["thread_id"])


@register("stream_input_alerts", """SELECT conv_id AS thread_id, turn FROM conversations
WHERE coalesce(role, '') <> '' AND strpos(lower(role), 'assist') > 0""")
def q_stream_input_alerts(spark, d):
    """ST4: alerts for messages from an 'assist'-named speaker."""
    m = load(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "turn",
                                               F.col("role").alias("name"))
    return replay(m, "st4", lambda src: so.stream_input_alerts(src, pattern="assist").select("thread_id", "turn"), order="turn")


_RUN_STATUS = """CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'in_progress'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"""


@register("stream_run_monitor", f"""SELECT run_id, status, last_error, n_events FROM (
  SELECT user_id AS run_id, {_RUN_STATUS} AS status, CASE WHEN event_type = 'error' THEN props END AS last_error,
    CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_events,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_stream_run_monitor(spark, d):
    """ST5: latest run status from a replayed status stream."""
    e = load(spark, d, "events")
    st = (F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "in_progress")
          .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
          .otherwise("cancelled"))
    runs = e.select(F.col("user_id").alias("run_id"), "ts", "event_id", st.alias("status"),
                    F.when(F.col("event_type") == "error", F.col("props")).alias("last_error"))
    failed = side_path(spark, "st5-failed")          # failed runs, written from the same batches
    return replay(runs, "st5", so.stream_run_monitor, order="ts", mode="update", keys=["run_id"],
                  side=(failed, F.col("status") == "failed")).select("run_id", "status", "last_error", "n_events")


@register("stream_iteration_decision", f"""WITH {_DECISION_SQL}
SELECT thread_id, turn, quality, iteration, CAST(threshold AS DOUBLE) AS threshold, approved,
  CAST(emitted_quality AS DOUBLE) AS emitted_quality FROM decisions""")
def q_stream_iteration_decision(spark, d):
    """ST6: review decisions with a per-thread counter in state; the
    messages are replayed out of order (hash-split by sequence number)."""
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0))
    m = load(spark, d, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", (F.col("role") == "assistant").alias("is_review"),
        F.when(F.col("role") == "assistant", F.round(F.least(F.lit(1.0), words / F.lit(250.0)), 4)).alias("quality"))
    msgs = sq.sequence_number(m, ["thread_id"], ["turn"], out="seq")
    return replay(msgs, "st6", so.stream_iteration_decision, scatter=F.col("seq"))


@register("stream_trend", """SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
  CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def q_stream_trend(spark, d):
    """ST7: daily tumbling-window counts per event type, open windows too (update mode)."""
    e = load(spark, d, "events").select("event_type", "ts")
    return replay(e, "st7", lambda src: so.stream_trend(src, "event_type"), order="ts", mode="update",
                  keys=["event_type", "window_start", "window_end"])


@register("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
    IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk,
    event_id FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, CAST(count(*) AS BIGINT) AS n
FROM s GROUP BY user_id, sid""")
def q_stream_sessions(spark, d):
    """ST7: per-user session windows (30-minute gap, complete mode)."""
    e = load(spark, d, "events").select("user_id", "ts")
    return replay(e, "st7s", lambda src: so.stream_trend(src, "user_id", session_gap="30 minutes"), order="ts", mode="complete")


@register("stream_messages", "SELECT conv_id, turn, role, text FROM conversations")
def q_stream_messages(spark, d):
    """Continuous intake of agent messages from a thread log that grows while the stream is stopped
    and started again: every message once."""
    m = load(spark, d, "conversations")
    path, at = _path(spark, "log", "s5"), _path(spark, "stream", "s5")
    steps, out = _steps(m, "s5", 4, order="turn"), None
    for i in range(4):
        tl.append(steps.where(F.col("_part") == i).drop("_part"), path, "conv_id", "turn")
        out = drain(tl.read_log(spark, path, m.schema), "s5", at=at)
    return out


@register("stream_trend_sliding", """SELECT event_type, window_start, window_end, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT event_type, CAST(date_trunc('day', ts) - INTERVAL 1 DAY AS TIMESTAMP) AS window_start,
    CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end FROM events
  UNION ALL
  SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP), CAST(date_trunc('day', ts) + INTERVAL 2 DAY AS TIMESTAMP)
  FROM events) GROUP BY ALL""")
def q_stream_trend_sliding(spark, d):
    """ST7: two-day windows sliding by one day per event type, open windows too (update mode)."""
    e = load(spark, d, "events").select("event_type", "ts")
    return replay(e, "st7w", lambda src: so.stream_trend(src, "event_type", size="2 days", slide="1 day"), order="ts",
                  mode="update", keys=["event_type", "window_start", "window_end"])


@register("stream_trend_closed", """WITH w AS (SELECT event_type, ts, event_id % 10 = 0 AS tardy,
    CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end FROM events),
m AS (SELECT max(ts) FILTER (WHERE NOT tardy) - INTERVAL 1 DAY AS before_tardy, max(ts) - INTERVAL 1 DAY AS at_end FROM w)
SELECT event_type, window_start, window_end, CAST(count(*) AS BIGINT) AS n, tardy AND window_end <= before_tardy AS late
FROM w, m GROUP BY ALL HAVING late OR window_end <= any_value(at_end)""")
def q_stream_trend_closed(spark, d):
    """ST7 in append mode: daily windows that the watermark has closed, and what came too late for
    them.  Every tenth event arrives after all others."""
    e = load(spark, d, "events").select("event_type", "ts", (F.col("event_id") % 10 == 0).cast("int").alias("step"))
    return replay(e, "st7c", lambda src: so.stream_trend_closed(src, "event_type"), n_steps=2, scatter=F.col("step"),
                  combine=so.combine_windows)


@register("stream_sessions_closed", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
    IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk,
    event_id FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, CAST(count(*) AS BIGINT) AS n
FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def q_stream_sessions_closed(spark, d):
    """ST7 in append mode: sessions (30-minute gap) that the watermark has closed."""
    e = load(spark, d, "events").select("user_id", "ts")
    return replay(e, "st7sc", lambda src: so.stream_trend_closed(src, "user_id", size_ms=1_800_000, session=True), order="ts").where("not late").drop("late")
