"""Transcript analytics (H1-H17) and the review-iteration decision.

"Last message" style questions are grouped ``max_by`` aggregates (partial
aggregation map-side, so a hot thread collapses before the shuffle).
Ordered questions (previous id, running counts, transitions) use the
skew-safe helpers of :mod:`tessera.operators.sequence` instead of one
window per thread.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_ws
from tessera.operators import sequence as sq

# --- fixed values (must equal the reference's rules) -----------------------
UNKNOWN_SPEAKER = "(unknown)"
REASON_EMPTY = "No agents have spoken yet."
REASON_REVIEWER = "User input is needed after the reviewer's message."
REASON_OTHER = "User input is not needed if the last message is not from the reviewer."
REVIEW_PATTERN = "review"
MAX_ROUNDS = 5
# Review thresholds by iteration; iteration 4+ is force-approved at 0.80.
ITERATION_THRESHOLDS = ((1, 0.80), (2, 0.75), (3, 0.70))
FORCED_QUALITY = 0.80
MAX_REVISIONS = 3
ESCALATE_AFTER_CYCLES = 2        # more than 2 revision cycles -> human
BORDERLINE_MARGIN = 0.02         # ours: within .02 of the threshold
STOP_WORD = "n"                  # user reply that ends a conversation
ACTIVE_STATUSES = ("queued", "in_progress")
# Handoff graph (source -> target), agent names carry the suffix "Agent".
HANDOFF_EDGES = (
    ("ManagerAgent", "DataFeederAgent"),
    ("DataFeederAgent", "CredibilityCriticAgent"),
    ("DataFeederAgent", "SummarizerAgent"),
    ("CredibilityCriticAgent", "ReportWriterAgent"),
    ("ReportWriterAgent", "ReflectionCriticAgent"),
    ("SummarizerAgent", "CredibilityCriticAgent"),
    ("ReflectionCriticAgent", "ReportWriterAgent"),
    ("ReflectionCriticAgent", "TranslatorAgent"),
)
ITERATION_MARKER = r"ITERATION_COUNT:\s*([0-9]+)"
# -----------------------------------------------------------------------------


def last_message_by_role(messages: DataFrame, role: str | None = None, thread: str = "thread_id",
                         turn: str = "turn", cols=("role", "text")) -> DataFrame:
    """H1: the latest message (optionally of one role) per thread."""
    m = messages if role is None else messages.filter(F.col("role") == role)
    s = F.struct(F.col(turn).alias(turn), *[F.col(c).alias(c) for c in cols])
    return (m.groupBy(thread).agg(F.max_by(s, F.col(turn)).alias("_m"))
            .select(thread, *[F.col(f"_m.{c}").alias(c) for c in (turn, *cols)]))


def new_message_polls(polls: DataFrame, thread: str, order, msg_id: str = "msg_id") -> DataFrame:
    """H2: a poll emits when its message id is non-null and differs from the
    last non-null id seen before it in the same thread."""
    seen = F.when(F.col(msg_id).isNotNull(), F.struct(*order, F.col(msg_id).alias("_id")))
    out = (sq.running_max(polls, [thread], order, seen, "_last", inclusive=False)
           .withColumn("prev_msg_id", F.col("_last._id")))
    emitted = F.col(msg_id).isNotNull() & (F.col("prev_msg_id").isNull() | (F.col(msg_id) != F.col("prev_msg_id")))
    return out.withColumn("emitted", emitted).drop("_last")


def message_by_id(keys: DataFrame, messages: DataFrame, on) -> DataFrame:
    """H3: lookup of message keys; missing keys come back with found = false."""
    m = messages.withColumn("_hit", F.lit(True))
    return keys.join(m, list(on), "left").withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def citation_lines(annotations: DataFrame) -> DataFrame:
    """H4: one ``[title](url)`` line per annotation, duplicates kept."""
    return annotations.withColumn("line", F.format_string("[%s](%s)", F.col("title"), F.col("url")))


def render_message(messages: DataFrame, name: str = "name", content: str = "content",
                   items: str = "items") -> DataFrame:
    """H5: speaker = name or '(unknown)'; body = content, else one
    'Function: f' line per item plus 'Arguments: a' when a is non-empty."""
    lines = F.flatten(F.transform(F.col(items), lambda it: F.array(
        F.concat(F.lit("Function: "), it["function_name"]),
        F.when(F.coalesce(it["arguments"], F.lit("")) != "", F.concat(F.lit("Arguments: "), it["arguments"])))))
    calls = F.array_join(F.array_compact(lines), "\n")
    body = F.when(F.coalesce(F.col(content), F.lit("")) != "", F.col(content)).otherwise(F.coalesce(calls, F.lit("")))
    return messages.withColumn("speaker", F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN_SPEAKER))) \
        .withColumn("body", body)


def assemble_chunks(chunks: DataFrame, stream: str, order, content: str = "content",
                    is_final: str = "is_final") -> DataFrame:
    """H6: message number = finals strictly before the chunk + 1; a message
    is emitted (contents concatenated in order) only once its final chunk
    has arrived.  Unfinished messages are dropped before any collection."""
    c = chunks.withColumn("_f", F.col(is_final).cast("int"))
    c = sq.running_sum(c, [stream], order, "_f", "_prev_finals", inclusive=False)
    c = c.withColumn("msg_no", (F.col("_prev_finals") + 1).cast("bigint"))
    done = c.groupBy(stream, "msg_no").agg(F.max("_f").alias("_done")).filter(F.col("_done") == 1)
    c = c.join(done.select(stream, "msg_no"), [stream, "msg_no"], "left_semi")
    key = F.struct(*[F.col(o) for o in order], F.col(content).alias("_c"))
    return (c.groupBy(stream, "msg_no")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"), F.array_sort(F.collect_list(key)).alias("_a"))
            .select(stream, "msg_no", "n_chunks",
                    F.array_join(F.transform("_a", lambda x: F.coalesce(x["_c"], F.lit(""))), "").alias("content")))


def needs_user_input(threads: DataFrame, messages: DataFrame, thread: str = "thread_id",
                     name: str = "name", turn: str = "turn", pattern: str = REVIEW_PATTERN) -> DataFrame:
    """H7: per thread, does the last message come from a reviewer?"""
    last = messages.groupBy(thread).agg(F.max_by(F.col(name), F.col(turn)).alias("_last_name"),
                                        F.count(F.lit(1)).alias("_n"))
    j = threads.select(thread).join(last, thread, "left")
    nm = F.col("_last_name")
    reviewer = (F.coalesce(nm, F.lit("")) != "") & F.lower(nm).contains(pattern.lower())
    return j.select(
        thread,
        (F.col("_n").isNotNull() & F.coalesce(reviewer, F.lit(False))).alias("needs_input"),
        F.when(F.col("_n").isNull(), F.lit(REASON_EMPTY))
         .when(F.coalesce(reviewer, F.lit(False)), F.lit(REASON_REVIEWER))
         .otherwise(F.lit(REASON_OTHER)).alias("reason"))


def round_robin_conformance(messages: DataFrame, members, thread: str = "thread_id", turn: str = "turn",
                            speaker: str = "role", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """H8: the k-th message (0-based) should come from members[k mod n];
    at most ``max_rounds`` rounds."""
    n = len(members)
    s = sq.sequence_number(messages, [thread], [turn], out="_k")
    k = F.col("_k") - 1
    expected = F.element_at(F.array(*[F.lit(m) for m in members]), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    return (s.withColumn("expected", expected)
            .withColumn("conforms", F.coalesce(F.col(speaker) == F.col("expected"), F.lit(False)))
            .withColumn("round", (F.floor(k / n) + 1).cast("bigint"))
            .withColumn("within_rounds", F.col("round") <= max_rounds)
            .drop("_k"))


def transitions(df: DataFrame, thread: str, order, state: str) -> DataFrame:
    """Consecutive (source, target) pairs per thread, skew-safe."""
    return (sq.with_next_row(df, [thread], order, [state])
            .filter(F.col(f"next_{state}").isNotNull())
            .withColumnRenamed(state, "source").withColumnRenamed(f"next_{state}", "target")
            .drop("has_next"))


def handoff_conformance(trans: DataFrame, edges: DataFrame) -> DataFrame:
    """H9: transitions that are not edges of the handoff graph (anti join).
    ``edges`` is a rule table; the caller broadcasts it when it is bounded."""
    return trans.join(edges, ["source", "target"], "left_anti")


def handoff_counts(trans: DataFrame) -> DataFrame:
    """Transition counts and their share of the source's transitions."""
    from pyspark.sql import Window
    per = trans.groupBy("source", "target").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4))


def next_agent(state: DataFrame, agent: str = "agent", n_results: str = "n_results",
               approved: str = "approved", lang: str = "report_lang", translated: str = "translated") -> DataFrame:
    """Routing rules of the research workflow as one CASE expression."""
    a = F.col(agent)
    nxt = (F.when(a == "ManagerAgent", F.lit("DataFeederAgent"))
           .when(a == "DataFeederAgent", F.when(F.col(n_results) > 50, F.lit("SummarizerAgent"))
                 .otherwise(F.lit("CredibilityCriticAgent")))
           .when(a == "SummarizerAgent", F.lit("CredibilityCriticAgent"))
           .when(a == "CredibilityCriticAgent", F.lit("ReportWriterAgent"))
           .when(a == "ReportWriterAgent", F.lit("ReflectionCriticAgent"))
           .when(a == "ReflectionCriticAgent",
                 F.when(~F.col(approved), F.lit("ReportWriterAgent"))
                 .when((F.col(lang) != "zh") & ~F.col(translated), F.lit("TranslatorAgent"))
                 .otherwise(F.lit("done")))
           .when(a == "TranslatorAgent", F.lit("done")))
    return state.withColumn("next_agent", nxt)


def conversation_end(messages: DataFrame, thread: str = "thread_id", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """Drop everything from the first non-opening user message that is
    'n' (after strip + lower) or blank."""
    first = messages.groupBy(thread).agg(F.min(turn).alias("_first"))
    t = strip_ws(text)
    stop = (F.col(role) == "user") & (F.col(turn) > F.col("_first")) & \
        ((F.lower(t) == STOP_WORD) | (F.coalesce(t, F.lit("")) == ""))
    stops = (messages.join(first, thread).filter(stop)
             .groupBy(thread).agg(F.min(turn).alias("_stop")))
    return (messages.join(stops, thread, "left")
            .filter(F.col("_stop").isNull() | (F.col(turn) < F.col("_stop")))
            .drop("_stop"))


def final_result(messages: DataFrame, thread: str = "thread_id", turn: str = "turn", value: str = "text") -> DataFrame:
    """The last value of each thread."""
    return messages.groupBy(thread).agg(F.max(turn).alias("last_turn"),
                                        F.max_by(F.col(value), F.col(turn)).alias("final_value"))


def run_outcome(run_events: DataFrame, run: str = "run_id", ts: str = "ts", tie: str = "event_id",
                answered: DataFrame | None = None) -> DataFrame:
    """Latest status per run; queued/in_progress are active; a failed
    run carries its error and produces no report.

    With ``answered`` (the runs whose thread has an agent message) the rule is that of a script which
    goes on after a failure: a run that is over produces a report if and only if it has such a message."""
    key = F.struct(F.col(ts), F.col(tie))
    agg = run_events.groupBy(run).agg(
        F.max_by(F.col("status"), key).alias("status"),
        F.max_by(F.col("last_error"), key).alias("_err"),
        F.count(F.lit(1)).cast("bigint").alias("n_events"))
    report = ~F.col("status").isin(*ACTIVE_STATUSES, "failed")
    if answered is not None:
        agg = agg.join(answered.select(run).distinct().withColumn("_answered", F.lit(True)), run, "left")
        report = ~F.col("status").isin(*ACTIVE_STATUSES) & F.coalesce("_answered", F.lit(False))
    return agg.select(
        run, "status", "n_events",
        F.col("status").isin(*ACTIVE_STATUSES).alias("active"),
        F.when(F.col("status") == "failed", F.col("_err")).alias("last_error"),
        report.alias("produces_report"))


def threshold_for(iteration: Column) -> Column:
    out = F.lit(None).cast("double")
    for it, th in reversed(ITERATION_THRESHOLDS):
        out = F.when(iteration == it, F.lit(th)).otherwise(out)
    return out


def iteration_decision(reviews: DataFrame, thread: str = "thread_id", turn: str = "turn",
                       quality: str = "quality") -> DataFrame:
    """iteration = earlier reviews in the thread + 1; thresholds .80 /
    .75 / .70; iteration 4+ is approved with quality forced to .80."""
    r = sq.sequence_number(reviews, [thread], [turn], out="iteration")
    th = threshold_for(F.col("iteration"))
    forced = F.col("iteration") > MAX_REVISIONS
    return (r.withColumn("threshold", th)
            .withColumn("approved", forced | (F.col(quality) >= F.col("threshold")))
            .withColumn("emitted_quality", F.when(forced, F.lit(FORCED_QUALITY)).otherwise(F.col(quality))))


def escalations(decisions: DataFrame, thread: str = "thread_id", turn: str = "turn") -> DataFrame:
    """Threads with more than 2 revision cycles, or whose last review is
    within .02 of its threshold."""
    s = F.struct(F.col(turn), F.col("quality"), F.col("threshold"))
    agg = decisions.groupBy(thread).agg(F.count(F.lit(1)).cast("bigint").alias("n_reviews"),
                                        F.max_by(s, F.col(turn)).alias("_last"))
    many = F.col("n_reviews") > ESCALATE_AFTER_CYCLES
    border = F.coalesce(F.abs(F.col("_last.quality") - F.col("_last.threshold")) <= BORDERLINE_MARGIN, F.lit(False))
    return agg.select(thread, "n_reviews", (many | border).alias("escalate"),
                      F.when(many, F.lit("revision cycles")).when(border, F.lit("borderline quality")).alias("reason"))


def iteration_marker(messages: DataFrame, text: str = "text") -> DataFrame:
    """The ``ITERATION_COUNT:X`` marker as a number (null when absent, or
    when the number does not fit a bigint)."""
    raw = F.regexp_extract(F.col(text), ITERATION_MARKER, 1)
    return messages.withColumn("marker", F.when(raw != "", raw.try_cast("bigint")))


def compare_iterations(reviews: DataFrame, thread: str = "thread_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Each review's marker beside its counted iteration (L11's count,
    which is the one that holds); ``agrees`` is null where no marker is."""
    counted = sq.sequence_number(reviews, [thread], [turn], out="iteration")
    return iteration_marker(counted, text).withColumn("agrees", F.col("marker") == F.col("iteration"))


def deliverable(coverage: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Both gates met: coverage >= 0.75 and the last review approved."""
    last = decisions.groupBy(key).agg(F.max_by(F.col("approved"), F.col("iteration")).alias("approved"))
    return (coverage.join(last, key)
            .withColumn("deliverable", (F.col("coverage") >= 0.75) & F.col("approved")))
