"""Registered queries: transcript analytics (H1-H17) and L11 over
``conversations`` (threads) and ``events`` (polls, chunks, runs, transitions)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_PATTERN, has_han
from tessera.operators import credibility as cr
from tessera.operators import transcript as tr
from tessera.plans import derived as dv
from tessera.plans import sqlparts as sp
from tessera.plans.catalog import register
from tessera.sources.pages import page_links
from tessera.sources.tables import load

# Allowed transitions between event types for H9 (a parameter table, 8 edges).
EVENT_EDGES = (("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"),
               ("purchase", "view"), ("signup", "view"), ("error", "view"), ("view", "signup"))
ROSTER = ("ManagerAgent", "DataFeederAgent", "SummarizerAgent", "CredibilityCriticAgent",
          "ReportWriterAgent", "ReflectionCriticAgent", "TranslatorAgent")


def messages(spark, d):
    """conversations as chat messages: thread_id, turn, role, name (= role), text."""
    return load(spark, d, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", "role", F.col("role").alias("name"), "text")


def _events(spark, d):
    return load(spark, d, "events")


@register("last_message_by_role", """SELECT conv_id AS thread_id, max(turn) AS turn, 'assistant' AS role,
  arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def q_last_message(spark, d):
    """H1: latest assistant message per thread."""
    return tr.last_message_by_role(messages(spark, d), "assistant")


_POLL_ID = "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value / 10) AS BIGINT) END"


@register("new_message_polls", f"""SELECT user_id, event_id, msg_id, prev_msg_id,
  msg_id IS NOT NULL AND (prev_msg_id IS NULL OR msg_id <> prev_msg_id) AS emitted FROM (
  SELECT user_id, event_id, msg_id, last_value(msg_id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_msg_id
  FROM (SELECT user_id, event_id, ts, {_POLL_ID} AS msg_id FROM events))""")
def q_new_message_polls(spark, d):
    """H2: polls (events per user) emit only new, non-null message ids."""
    e = _events(spark, d).select("user_id", "event_id", "ts", F.when(
        F.col("event_type") != "error", F.floor(F.col("value") / 10).cast("bigint")).alias("msg_id"))
    out = tr.new_message_polls(e, "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id", "msg_id", "prev_msg_id", "emitted")


@register("message_by_id", """SELECT e.event_id, e.user_id AS thread_id, CAST(floor(e.value) AS BIGINT) % 9 AS turn,
  c.role, c.conv_id IS NOT NULL AS found
FROM events e LEFT JOIN conversations c ON c.conv_id = e.user_id AND c.turn = CAST(floor(e.value) AS BIGINT) % 9""")
def q_message_by_id(spark, d):
    """H3: message lookups (keys derived from events); misses reported."""
    keys = _events(spark, d).select("event_id", F.col("user_id").alias("thread_id"),
                                    (F.floor("value").cast("bigint") % 9).alias("turn"))
    m = messages(spark, d).select("thread_id", "turn", "role")
    return tr.message_by_id(keys, m, ["thread_id", "turn"]).select("event_id", "thread_id", "turn", "role", "found")


@register("citation_lines", sp.sql(sp.page_links(), """SELECT page_id, pos,
  '[' || anchor || '](' || href || ')' AS line FROM page_links"""))
def q_citation_lines(spark, d):
    """H4: one markdown link line per annotation (duplicates kept)."""
    ann = page_links(load(spark, d, "pages")).select("page_id", "pos", F.col("anchor").alias("title"),
                                                     F.col("href").alias("url"))
    return tr.citation_lines(ann).select("page_id", "pos", "line")


@register("render_message", """SELECT conv_id, turn,
  coalesce(nullif(CASE WHEN role = 'system' THEN NULL ELSE role END, ''), '(unknown)') AS speaker,
  CASE WHEN turn % 3 <> 2 AND coalesce(text, '') <> '' THEN text
       ELSE 'Function: search' || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || 'Arguments: ' || text ELSE '' END
            || chr(10) || 'Function: rank' END AS body
FROM conversations""")
def q_render_message(spark, d):
    """H5: speaker and body of every message; every third message carries
    function calls instead of content."""
    c = load(spark, d, "conversations")
    items = F.array(F.struct(F.lit("search").alias("function_name"), F.col("text").alias("arguments")),
                    F.struct(F.lit("rank").alias("function_name"), F.lit("").alias("arguments")))
    m = c.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("name"),
                 F.when(F.col("turn") % 3 != 2, F.col("text")).alias("content"), items.alias("items"))
    return tr.render_message(m).select("conv_id", "turn", "speaker", "body")


@register("assemble_chunks", """SELECT user_id, msg_no, CAST(count(*) AS BIGINT) AS n_chunks,
  string_agg(event_type, '' ORDER BY ts, event_id) AS content FROM (
  SELECT user_id, ts, event_id, event_type, event_type = 'purchase' AS fin,
    CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
      ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS msg_no
  FROM events) GROUP BY user_id, msg_no HAVING bool_or(fin)""")
def q_assemble_chunks(spark, d):
    """H6: events as stream chunks (purchase = final chunk) assembled into messages."""
    e = _events(spark, d).select("user_id", "ts", "event_id", F.col("event_type").alias("content"),
                                 (F.col("event_type") == "purchase").alias("is_final"))
    return tr.assemble_chunks(e, "user_id", ["ts", "event_id"])


@register("needs_user_input", f"""SELECT t.thread_id,
  l.thread_id IS NOT NULL AND coalesce(l.nm, '') <> '' AND strpos(lower(l.nm), 'assist') > 0 AS needs_input,
  CASE WHEN l.thread_id IS NULL THEN {sp.q(tr.REASON_EMPTY)}
       WHEN coalesce(l.nm, '') <> '' AND strpos(lower(l.nm), 'assist') > 0 THEN {sp.q(tr.REASON_REVIEWER)}
       ELSE {sp.q(tr.REASON_OTHER)} END AS reason
FROM (SELECT DISTINCT user_id AS thread_id FROM events) t
LEFT JOIN (SELECT conv_id AS thread_id, arg_max(role, turn) AS nm FROM conversations GROUP BY conv_id) l
  ON l.thread_id = t.thread_id""")
def q_needs_user_input(spark, d):
    """H7: threads (users) whose last message came from an 'assist'-named speaker."""
    threads = _events(spark, d).select(F.col("user_id").alias("thread_id")).distinct()
    return tr.needs_user_input(threads, messages(spark, d), pattern="assist")


@register("round_robin_conformance", """SELECT conv_id AS thread_id, turn, role,
  CASE k % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS expected,
  coalesce(role = CASE k % 2 WHEN 0 THEN 'user' ELSE 'assistant' END, FALSE) AS conforms,
  CAST(k // 2 + 1 AS BIGINT) AS round, k // 2 + 1 <= 5 AS within_rounds
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)""")
def q_round_robin(spark, d):
    """H8: user / assistant alternation within five rounds."""
    m = messages(spark, d).select("thread_id", "turn", "role")
    return tr.round_robin_conformance(m, ["user", "assistant"]).select(
        "thread_id", "turn", "role", "expected", "conforms", "round", "within_rounds")


_EDGE_VALUES = ", ".join(f"({sp.q(a)}, {sp.q(b)})" for a, b in EVENT_EDGES)
_TRANS_SQL = """trans AS (SELECT user_id, event_id, event_type AS source,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)"""


def _transitions(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "ts", "event_type")
    return tr.transitions(e, "user_id", ["ts", "event_id"], "event_type")


@register("handoff_conformance", f"""WITH {_TRANS_SQL}
SELECT user_id, event_id, source, target FROM trans WHERE target IS NOT NULL
  AND (source, target) NOT IN (SELECT (a, b) FROM (VALUES {_EDGE_VALUES}) v(a, b))""")
def q_handoff_conformance(spark, d):
    """H9: event transitions outside the allowed edge table."""
    edges = spark.createDataFrame(list(EVENT_EDGES), "source string, target string")
    return tr.handoff_conformance(_transitions(spark, d), F.broadcast(edges)).select(
        "user_id", "event_id", "source", "target")


_HANDOFF_SQL = """handoffs AS (SELECT conv_id AS thread_id, turn, agent AS source,
  lead(agent) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM (SELECT conv_id, turn,
  (['ManagerAgent', 'DataFeederAgent', 'SummarizerAgent', 'CredibilityCriticAgent', 'ReportWriterAgent',
    'ReflectionCriticAgent', 'TranslatorAgent'])[length(text) % 7 + 1] AS agent FROM conversations))"""


@register("agent_handoff_conformance", f"""WITH {_HANDOFF_SQL}
SELECT thread_id, turn, source, target FROM handoffs WHERE target IS NOT NULL AND (source, target) NOT IN (
  SELECT (a, b) FROM (VALUES ('ManagerAgent', 'DataFeederAgent'), ('DataFeederAgent', 'CredibilityCriticAgent'),
    ('DataFeederAgent', 'SummarizerAgent'), ('CredibilityCriticAgent', 'ReportWriterAgent'),
    ('ReportWriterAgent', 'ReflectionCriticAgent'), ('SummarizerAgent', 'CredibilityCriticAgent'),
    ('ReflectionCriticAgent', 'ReportWriterAgent'), ('ReflectionCriticAgent', 'TranslatorAgent')) v(a, b))""")
def q_agent_handoffs(spark, d):
    """H9: agent handoffs outside the workflow's graph; a message's agent is
    derived from its length."""
    agent = F.element_at(F.array(*[F.lit(a) for a in ROSTER]), (F.length("text") % 7 + 1).cast("int"))
    m = messages(spark, d).select("thread_id", "turn", agent.alias("agent"))
    edges = spark.createDataFrame(list(tr.HANDOFF_EDGES), "source string, target string")
    return tr.handoff_conformance(tr.transitions(m, "thread_id", ["turn"], "agent"), F.broadcast(edges)).select(
        "thread_id", "turn", "source", "target")


@register("handoff_counts", f"""WITH {_TRANS_SQL}
SELECT source, target, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY source), 4) AS share
FROM trans WHERE target IS NOT NULL GROUP BY source, target""")
def q_handoff_counts(spark, d):
    """Transition counts and share per source."""
    return tr.handoff_counts(_transitions(spark, d))


_ROSTER_SQL = "CASE turn % 7 " + " ".join(f"WHEN {i} THEN {sp.q(a)}" for i, a in enumerate(ROSTER)) + " END"


@register("next_agent", f"""SELECT conv_id, turn, agent, CASE agent
  WHEN 'ManagerAgent' THEN 'DataFeederAgent'
  WHEN 'DataFeederAgent' THEN CASE WHEN n_results > 50 THEN 'SummarizerAgent' ELSE 'CredibilityCriticAgent' END
  WHEN 'SummarizerAgent' THEN 'CredibilityCriticAgent'
  WHEN 'CredibilityCriticAgent' THEN 'ReportWriterAgent'
  WHEN 'ReportWriterAgent' THEN 'ReflectionCriticAgent'
  WHEN 'ReflectionCriticAgent' THEN CASE WHEN NOT approved THEN 'ReportWriterAgent'
       WHEN report_lang <> 'zh' AND NOT translated THEN 'TranslatorAgent' ELSE 'done' END
  WHEN 'TranslatorAgent' THEN 'done' END AS next_agent
FROM (SELECT conv_id, turn, {_ROSTER_SQL} AS agent, length(text) % 100 AS n_results,
  length(text) % 2 = 0 AS approved, CASE WHEN regexp_matches(text, '\\p{{Han}}') THEN 'zh' ELSE 'en' END AS report_lang,
  turn % 5 = 0 AS translated FROM conversations)""")
def q_next_agent(spark, d):
    """Workflow routing for agent states derived from each message."""
    c = load(spark, d, "conversations")
    roster = F.element_at(F.array(*[F.lit(a) for a in ROSTER]), (F.col("turn") % 7 + 1).cast("int"))
    st = c.select("conv_id", "turn", roster.alias("agent"), (F.length("text") % 100).alias("n_results"),
                  (F.length("text") % 2 == 0).alias("approved"),
                  F.when(has_han("text"), F.lit("zh")).otherwise(F.lit("en")).alias("report_lang"),
                  (F.col("turn") % 5 == 0).alias("translated"))
    return tr.next_agent(st).select("conv_id", "turn", "agent", "next_agent")


@register("conversation_end", """WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id),
s AS (SELECT c.conv_id, min(c.turn) AS stop FROM conversations c JOIN f ON f.conv_id = c.conv_id
  WHERE c.role = 'user' AND c.turn > f.first AND (lower(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g')) = 'n'
        OR coalesce(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), '') = '') GROUP BY c.conv_id)
SELECT c.conv_id AS thread_id, c.turn, c.role FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id
WHERE s.stop IS NULL OR c.turn < s.stop""")
def q_conversation_end(spark, d):
    """Messages kept before a user's stop reply."""
    return tr.conversation_end(messages(spark, d)).select("thread_id", "turn", "role")


@register("final_result", """SELECT conv_id AS thread_id, max(turn) AS last_turn, arg_max(text, turn) AS final_value
FROM conversations GROUP BY conv_id""")
def q_final_result(spark, d):
    """Last value per thread."""
    return tr.final_result(messages(spark, d))


_STATUS = """CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed'
  WHEN 'error' THEN 'failed' ELSE 'cancelled' END"""


@register("run_outcome", f"""SELECT run_id, status, n_events, status IN ('queued', 'in_progress') AS active,
  CASE WHEN status = 'failed' THEN err END AS last_error,
  status NOT IN ('queued', 'in_progress', 'failed') AS produces_report FROM (
  SELECT user_id AS run_id, {_STATUS} AS status, CASE WHEN event_type = 'error' THEN props END AS err,
    CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_events,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_run_outcome(spark, d):
    """Latest run status (events as run status changes)."""
    return tr.run_outcome(_runs(spark, d)).select("run_id", "status", "n_events", "active", "last_error", "produces_report")


@register("run_outcome_after_failure", f"""SELECT run_id, status, status NOT IN ('queued', 'in_progress') AND answered AS produces_report FROM (
  SELECT user_id AS run_id, {_STATUS} AS status, bool_or(event_type = 'signup') OVER (PARTITION BY user_id) AS answered,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_run_outcome_after_failure(spark, d):
    """H14, the script's rule: a run that is over, failed or not, has a report if its thread has an
    agent message (here: a signup event)."""
    answered = _events(spark, d).where("event_type = 'signup'").select(F.col("user_id").alias("run_id"))
    return tr.run_outcome(_runs(spark, d), answered=answered).select("run_id", "status", "produces_report")


def _runs(spark, d):
    e = _events(spark, d)
    st = (F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "in_progress")
          .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
          .otherwise("cancelled"))
    return e.select(F.col("user_id").alias("run_id"), "ts", "event_id", st.alias("status"),
                    F.when(F.col("event_type") == "error", F.col("props")).alias("last_error"))


def reviews(spark, d):
    """Critic reviews: assistant messages, quality = min(1, words / 250)."""
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0))
    return messages(spark, d).filter(F.col("role") == "assistant").select(
        "thread_id", "turn", F.round(F.least(F.lit(1.0), words / F.lit(250.0)), 4).alias("quality"))


_DECISION_SQL = f"""decisions AS (SELECT thread_id, turn, quality, iteration, threshold,
  iteration > 3 OR quality >= threshold AS approved,
  CASE WHEN iteration > 3 THEN 0.8 ELSE quality END AS emitted_quality FROM (
  SELECT thread_id, turn, quality, iteration,
    CASE iteration WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.7 END AS threshold FROM (
    SELECT conv_id AS thread_id, turn,
      round(least(1.0, len(regexp_extract_all(text, {sp.q(TOKEN_PATTERN)})) / 250.0), 4) AS quality,
      CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS iteration
    FROM conversations WHERE role = 'assistant')))"""


@register("iteration_decision", f"""WITH {_DECISION_SQL}
SELECT thread_id, turn, quality, iteration, CAST(threshold AS DOUBLE) AS threshold, approved,
  CAST(emitted_quality AS DOUBLE) AS emitted_quality FROM decisions""")
def q_iteration_decision(spark, d):
    """Review iteration, threshold and approval per critic message."""
    return tr.iteration_decision(reviews(spark, d)).select(
        "thread_id", "turn", "quality", "iteration", "threshold", "approved", "emitted_quality")


@register("escalations", f"""WITH {_DECISION_SQL}
SELECT thread_id, n_reviews, n_reviews > 2 OR coalesce(abs(q - th) <= 0.02, FALSE) AS escalate,
  CASE WHEN n_reviews > 2 THEN 'revision cycles' WHEN coalesce(abs(q - th) <= 0.02, FALSE) THEN 'borderline quality' END AS reason
FROM (SELECT thread_id, CAST(count(*) AS BIGINT) AS n_reviews, arg_max(quality, turn) AS q,
  arg_max(CAST(threshold AS DOUBLE), turn) AS th FROM decisions GROUP BY thread_id)""")
def q_escalations(spark, d):
    """Threads for human attention."""
    return tr.escalations(tr.iteration_decision(reviews(spark, d)))


@register("iteration_marker", f"""SELECT conv_id AS thread_id, turn,
  CASE WHEN regexp_extract(text, {sp.q(tr.ITERATION_MARKER)}, 1) <> ''
       THEN TRY_CAST(regexp_extract(text, {sp.q(tr.ITERATION_MARKER)}, 1) AS BIGINT) END AS marker
FROM conversations""")
def q_iteration_marker(spark, d):
    """Iteration markers written into messages."""
    return tr.iteration_marker(messages(spark, d)).select("thread_id", "turn", "marker")


@register("iteration_comparison", """SELECT thread_id, turn, iteration, marker, marker = iteration AS agrees FROM (
  SELECT conv_id AS thread_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS iteration,
    TRY_CAST(nullif(regexp_extract(text || CASE WHEN length(text) % 3 > 0
      THEN ' ITERATION_COUNT: ' || CAST(turn // 2 + 1 AS VARCHAR) ELSE '' END,
      'ITERATION_COUNT:\\s*([0-9]+)', 1), '') AS BIGINT) AS marker
  FROM conversations WHERE role = 'assistant')""")
def q_iteration_comparison(spark, d):
    """The markers against the counted iteration (two of three critic
    messages are given a marker, derived from their turn)."""
    mark = F.when(F.length("text") % 3 > 0,
                  F.concat(F.lit(" ITERATION_COUNT: "), (F.floor(F.col("turn") / 2) + 1).cast("string"))).otherwise("")
    m = messages(spark, d).filter(F.col("role") == "assistant").select(
        "thread_id", "turn", F.concat("text", mark).alias("text"))
    return tr.compare_iterations(m).select("thread_id", "turn", "iteration", "marker", "agrees")


@register("deliverable", sp.sql(sp.web_tiered(), f"""SELECT c.query_id, c.coverage, l.approved,
  c.coverage >= 0.75 AND l.approved AS deliverable FROM (
  SELECT query_id, round(0.5 * least(1.0, CAST(count(DISTINCT domain) AS DOUBLE) / 5.0)
    + 0.5 * avg({sp.tier_weight('tier')}), 4) AS coverage FROM web_tiered GROUP BY query_id) c
JOIN (SELECT thread_id, arg_max(approved, iteration) AS approved FROM (
  SELECT conv_id AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 3 OR
    round(least(1.0, len(regexp_extract_all(text, {sp.q(TOKEN_PATTERN)})) / 250.0), 4) >=
      CASE row_number() OVER (PARTITION BY conv_id ORDER BY turn) WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.7 END
      AS approved
  FROM conversations WHERE role = 'assistant') GROUP BY thread_id) l ON l.thread_id = c.query_id"""))
def q_deliverable(spark, d):
    """Coverage gate and review gate both met (thread i reviews request i)."""
    cov = cr.coverage_score(dv.web_tiered(spark, d))
    dec = tr.iteration_decision(reviews(spark, d)).withColumnRenamed("thread_id", "query_id")
    return tr.deliverable(cov, dec, "query_id").select("query_id", "coverage", "approved", "deliverable")
