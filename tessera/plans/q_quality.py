"""Registered queries: filters (R2-R4, R7, R8), credibility (C1-C7) and
summarisation (M1, M3-M8, M10, M11)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import extract_domain
from tessera.operators import credibility as cr
from tessera.operators import retrieve as rt
from tessera.operators import summarise as sm
from tessera.plans import derived as dv
from tessera.plans import sqlparts as sp
from tessera.plans.catalog import register
from tessera.sources.tables import load

AS_OF = "2024-01-31 00:00:00"


def _docs(spark, d, *cols):
    return load(spark, d, "documents").select("doc_id", *cols)


# --- R2, R3, R4, R7, R8 -----------------------------------------------------------
@register("phrase_filter", sp.sql(sp.doc_search() + sp.phrase_requests(), """SELECT s.query_id, s.rank, s.doc_id
FROM doc_search s JOIN documents d ON d.doc_id = s.doc_id JOIN phrase_req r ON r.query_id = s.query_id
WHERE len(list_filter(regexp_extract_all(r.query, '"([^"]+)"', 1),
                      lambda p: strpos(lower(d.text), lower(p)) = 0)) = 0"""))
def q_phrase_filter(spark, d):
    """R2: results must contain every quoted phrase of the request."""
    pr = dv.phrase_requests(spark, d).select("query_id", "query")
    res = dv.doc_search(spark, d).join(_docs(spark, d, "text"), "doc_id").join(pr, "query_id")
    return rt.phrase_filter(res).select("query_id", "rank", "doc_id")


@register("time_range_filter", f"""SELECT event_id, event_type, ts FROM events WHERE
  CASE event_type WHEN 'view' THEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY
    WHEN 'click' THEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
    WHEN 'purchase' THEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 MONTH
    WHEN 'signup' THEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 YEAR ELSE TRUE END""")
def q_time_range_filter(spark, d):
    """Time window by requested range (events carry the range by type)."""
    return rt.time_range_filter(dv.event_ranges(spark, d), "ts", "time_range", AS_OF).select(
        "event_id", "event_type", "ts")


@register("topic_filter", sp.sql(sp.doc_search(), """SELECT s.query_id, s.rank, s.doc_id
FROM doc_search s JOIN documents d ON d.doc_id = s.doc_id
WHERE s.query_id % 2 = 0 OR d.source = 'src' || CAST(s.query_id % 20 AS VARCHAR)"""))
def q_topic_filter(spark, d):
    """General keeps all; otherwise the document source must equal the topic."""
    hits = dv.doc_search(spark, d).join(_docs(spark, d, "source"), "doc_id")
    wanted = F.when(F.col("query_id") % 2 == 0, F.lit("general")).otherwise(
        F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return rt.topic_filter(hits.withColumn("wanted", wanted), "source", "wanted").select("query_id", "rank", "doc_id")


@register("merge_searches", sp.sql(sp.expanded_search(), """SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank
  FROM (SELECT query_id, doc_id, max(score) AS score FROM exp_search GROUP BY query_id, doc_id))"""))
def q_merge_searches(spark, d):
    """Q2 + R7: primary/aspect/alternative searches merged, best score per document."""
    return rt.merge_searches(dv.expanded_search(spark, d)).select("query_id", "doc_id", "score", "rank")


@register("rerank", sp.sql(sp.web_tiered(), f"""SELECT query_id, page_id, tier, rerank_score, rank FROM (
  SELECT query_id, page_id, tier, rerank_score, CAST(row_number() OVER (PARTITION BY query_id
         ORDER BY rerank_score DESC, page_id) AS BIGINT) AS rank
  FROM (SELECT query_id, page_id, tier, round(score * {sp.tier_weight('tier')} * 1.0, 4) AS rerank_score
        FROM web_tiered))"""))
def q_rerank(spark, d):
    """Relevance x tier weight x recency (pages are undated: neutral)."""
    return rt.rerank(dv.web_tiered(spark, d), id_col="page_id").select(
        "query_id", "page_id", "tier", "rerank_score", "rank")


# --- C1-C7 ------------------------------------------------------------------------
@register("tier_sources", f"""SELECT page_id, {sp.domain('url')} AS domain,
  {sp.tier_case(sp.domain('url'), cr.TIERS)} AS tier FROM pages""")
def q_tier_sources(spark, d):
    """Reference tiers over page hosts."""
    p = load(spark, d, "pages").select("page_id", extract_domain("url").alias("domain"))
    return cr.tier_sources(p)


@register("tier_sources_table", f"""SELECT page_id, {sp.domain('url')} AS domain,
  {sp.tier_case(sp.domain('url'), dv.TIER_PARAMS)} AS tier FROM pages""")
def q_tier_sources_table(spark, d):
    """A caller-supplied tier table, matched on label-boundary suffixes."""
    p = load(spark, d, "pages").select("page_id", extract_domain("url").alias("domain"))
    return cr.tier_sources_table(p, dv.tier_table(spark), "page_id").select("page_id", "domain", "tier")


_COVERAGE_SQL = f"""SELECT query_id, CAST(count(*) AS BIGINT) AS n_results,
  CAST(count(DISTINCT domain) AS BIGINT) AS n_domains,
  round(0.5 * least(1.0, CAST(count(DISTINCT domain) AS DOUBLE) / 5.0) + 0.5 * avg({sp.tier_weight('tier')}), 4) AS coverage,
  round(avg(CASE WHEN tier IS NULL THEN 1.0 ELSE 0.0 END), 4) AS untiered_share
FROM web_tiered GROUP BY query_id"""


@register("coverage_score", sp.sql(sp.web_tiered(), _COVERAGE_SQL))
def q_coverage_score(spark, d):
    """Coverage per request."""
    return cr.coverage_score(dv.web_tiered(spark, d))


@register("needs_verification", sp.sql(sp.web_tiered(), f"""SELECT *,
  coverage < 0.75 OR untiered_share > 0.5 AS needs_verification FROM ({_COVERAGE_SQL})"""))
def q_needs_verification(spark, d):
    """Verification flag."""
    return cr.needs_verification(cr.coverage_score(dv.web_tiered(spark, d)))


def _facts(spark, d):
    docs = _docs(spark, d, "text")
    return sm.extract_facts(sm.sentences(docs, "doc_id"), "doc_id")


@register("corroboration", sp.sql(sp.doc_facts(), """SELECT fact, CAST(count(DISTINCT d.source) AS BIGINT) AS n_sources,
  count(DISTINCT d.source) >= 2 AS corroborated
FROM doc_facts f JOIN documents d ON d.doc_id = f.doc_id GROUP BY fact"""))
def q_corroboration(spark, d):
    """C4: facts (numbers) supported by two or more distinct sources."""
    facts = _facts(spark, d).join(_docs(spark, d, "source"), "doc_id")
    return cr.corroboration(facts, "fact", "source")


@register("find_conflicts", f"""WITH kf AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {sp.q(sm.KEYED_FACT_PATTERN)}, 1))) AS key,
  unnest(regexp_extract_all(text, {sp.q(sm.KEYED_FACT_PATTERN)}, 2)) AS value FROM documents)
SELECT doc_id, key, value FROM kf WHERE key IN (SELECT key FROM kf GROUP BY key HAVING count(DISTINCT value) > 1 AND count(DISTINCT doc_id) > 1)""")
def q_find_conflicts(spark, d):
    """Keyed facts whose key carries different values in different documents."""
    return cr.find_conflicts(sm.keyed_facts(_docs(spark, d, "text"), "doc_id"), source="doc_id").select("doc_id", "key", "value")


@register("coverage_gaps", sp.sql(sp.doc_search(), f"""SELECT DISTINCT query_id, term FROM
  (SELECT query_id, unnest({sp.tokens('query')}) AS term FROM params) e
WHERE NOT EXISTS (SELECT 1 FROM doc_search s JOIN documents d ON d.doc_id = s.doc_id
  WHERE s.query_id = e.query_id AND list_contains({sp.tokens('d.text')}, e.term))"""))
def q_coverage_gaps(spark, d):
    """Query terms that none of the request's results contain."""
    qt = rt.query_terms(dv.params(spark, d))
    hits = dv.doc_search(spark, d).select("query_id", "doc_id")
    from tessera.functions.text import explode_rows, tokenize
    # tokenize only documents that are hits of some request
    hit_docs = _docs(spark, d, "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    dt = (explode_rows(hit_docs, ["doc_id"], F.array_distinct(tokenize("text")), "term")
          .join(qt.select("term").distinct(), "term", "left_semi"))
    found = hits.join(dt, "doc_id").select("query_id", "term").distinct()
    return cr.coverage_gaps(qt, found)


@register("scope_profile", """SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT user_id) AS BIGINT) AS n_actors, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS n_days,
  round(avg(CASE WHEN ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 1.0 ELSE 0.0 END), 4) AS recent_share,
  CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS span_days
FROM events GROUP BY ROLLUP (event_type)""")
def q_scope_profile(spark, d):
    """Temporal span and recency by event type, with a total row."""
    return cr.scope_profile(load(spark, d, "events"))


@register("scope_languages", """SELECT lang, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT source) AS BIGINT) AS n_sources,
  round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM documents), 4) AS share FROM documents GROUP BY lang""")
def q_scope_languages(spark, d):
    """Languages of the corpus."""
    return cr.language_profile(load(spark, d, "documents").select("lang", "source"))


@register("scope_regions", """WITH o AS (SELECT r_name AS region, o_orderdate AS ts, o_custkey FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT region, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_actors, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS n_days,
  round(avg(CASE WHEN ts > (SELECT max(ts) FROM o) - INTERVAL 30 DAY THEN 1.0 ELSE 0.0 END), 4) AS recent_share,
  CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS span_days
FROM o GROUP BY ROLLUP (region)""")
def q_scope_regions(spark, d):
    """Span, recency and actors by region (orders of each region's customers)."""
    t = {n: load(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    o = (t["orders"].select("o_custkey", F.col("o_orderdate").alias("ts"))
         .join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
         .join(t["nation"].select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
         .join(t["region"].select("r_regionkey", F.col("r_name").alias("region")), "r_regionkey"))
    return cr.scope_profile(o, dim="region", actor="o_custkey", recent_days=30)


def _order_scope(spark, d):
    t = {n: load(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    return (t["orders"].select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("bigint").alias("period"), "o_orderpriority")
            .join(t["customer"].select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
            .join(t["nation"].select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
            .join(t["region"].select("r_regionkey", F.col("r_name").alias("region")), "r_regionkey")
            .select("period", F.col("o_orderpriority").alias("priority"), "region", "c_custkey"))


@register("scope_cube", """WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS period, o_orderpriority AS priority, r_name AS region, o_custkey FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT period, priority, region, CAST(grouping_id(period, priority, region) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_actors, TRUE AS estimate_ok
FROM o GROUP BY CUBE (period, priority, region)""")
def q_scope_cube(spark, d):
    """Orders and customers by period x priority x region.  The exact counts stand beside the
    sketches' (only this check counts distinct customers exactly): they lie within five standard errors."""
    o = _order_scope(spark, d)
    dims = ["period", "priority", "region"]
    exact = (o.distinct().cube(*dims).agg(F.grouping_id().cast("bigint").alias("level"), F.count_distinct("c_custkey").cast("bigint").alias("exact")))
    cube = cr.scope_cube(o, dims, "c_custkey")
    same = [cube[c].eqNullSafe(exact[c]) for c in [*dims, "level"]]
    off = F.abs(cube["n_actors"] - exact["exact"])
    return cube.join(exact, same).select(*[cube[c] for c in [*dims, "level", "n"]], exact["exact"].alias("n_actors"),
                                         (off <= F.greatest(F.lit(1.0), 5 * cr.SKETCH_ERROR * exact["exact"])).alias("estimate_ok"))


# --- M1, M3-M8, M10, M11 ------------------------------------------------------------
@register("size_route", sp.sql(sp.params(), f"""SELECT p.query_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_matches,
  CASE WHEN coalesce(m.n, 0) > 50 THEN 'summarise' ELSE 'credibility' END AS route
FROM params p LEFT JOIN (SELECT q.query_id, count(DISTINCT t.doc_id) AS n FROM
  (SELECT DISTINCT query_id, unnest({sp.tokens('query')}) AS term FROM params) q JOIN
  (SELECT DISTINCT doc_id, unnest({sp.tokens('text')}) AS term FROM documents) t ON t.term = q.term
  GROUP BY q.query_id) m ON m.query_id = p.query_id"""))
def q_size_route(spark, d):
    """M1: requests with more than 50 matching documents are summarised first."""
    p = dv.params(spark, d)
    counts = rt.match_counts(load(spark, d, "documents"), p, index=dv.doc_index(spark, d))
    full = p.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce(F.col("n_matches"), F.lit(0).cast("bigint")).alias("n_matches"))
    return sm.size_route(full, "n_matches")


@register("rank_in_theme", sp.sql(sp.doc_search(), """SELECT s.query_id, s.doc_id, d.source,
  CAST(row_number() OVER (PARTITION BY s.query_id, d.source ORDER BY s.score DESC, s.doc_id) AS BIGINT) AS theme_rank
FROM doc_search s JOIN documents d ON d.doc_id = s.doc_id"""))
def q_rank_in_theme(spark, d):
    """M3: results ranked within their theme (source)."""
    hits = dv.doc_search(spark, d).join(_docs(spark, d, "source"), "doc_id")
    return sm.rank_in_theme(hits, ["query_id", "source"]).select("query_id", "doc_id", "source", "theme_rank")


def _summary(spark, d):
    hits = dv.doc_search(spark, d).select("query_id", "rank", "doc_id")
    # split sentences only for documents that are hits
    docs = _docs(spark, d, "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    sents = sm.sentences(docs, "doc_id")
    return sm.extractive_summary(hits.join(sents, "doc_id"), "query_id", ["rank", "sent_pos"])


_SUMMARY_SQL = """summary AS (SELECT * FROM (SELECT s.query_id, s.rank, s.doc_id, t.sent_pos, t.sentence, t.n_tokens,
  CAST(sum(t.n_tokens) OVER (PARTITION BY s.query_id ORDER BY s.rank, t.sent_pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_tokens
  FROM doc_search s JOIN doc_sent t ON t.doc_id = s.doc_id) WHERE running_tokens <= 1200)"""


@register("extractive_summary", sp.sql(sp.doc_search() + sp.doc_sentences() + [_SUMMARY_SQL],
                                       "SELECT query_id, rank, doc_id, sent_pos, n_tokens, running_tokens FROM summary"))
def q_extractive_summary(spark, d):
    """M4: sentences of the ranked results within the 1200-token budget."""
    return _summary(spark, d).select("query_id", "rank", "doc_id", "sent_pos", "n_tokens", "running_tokens")


@register("summary_flags", sp.sql(sp.doc_search() + sp.doc_sentences() + [_SUMMARY_SQL],
                                  """SELECT query_id, CAST(sum(n_tokens) AS BIGINT) AS summary_tokens,
  CAST(count(*) AS BIGINT) AS n_sentences, sum(n_tokens) < 800 AS too_short FROM summary GROUP BY query_id"""))
def q_summary_flags(spark, d):
    """M4: summaries under 800 tokens flagged."""
    return sm.summary_flags(_summary(spark, d), "query_id")


@register("render_summary", sp.sql(sp.doc_search() + sp.doc_sentences() + [_SUMMARY_SQL],
                                   """SELECT query_id, '## Themes' || chr(10) ||
  string_agg('- ' || sentence, chr(10) ORDER BY rank, sent_pos) AS summary_md FROM summary GROUP BY query_id"""))
def q_render_summary(spark, d):
    """The budgeted summary rendered as markdown bullets."""
    return sm.render_summary(_summary(spark, d), "query_id", ["rank", "sent_pos"])


@register("extract_facts", sp.sql(sp.doc_facts(), "SELECT doc_id, sent_pos, fact_pos, fact, kind FROM doc_facts"))
def q_extract_facts(spark, d):
    """M5: numbers, percentages and dates per sentence."""
    return _facts(spark, d)


@register("trend", """SELECT event_type, period, n, prev_n, n - prev_n AS change FROM (
  SELECT event_type, period, n, lag(n) OVER (PARTITION BY event_type ORDER BY period) AS prev_n FROM (
    SELECT event_type, date_trunc('day', ts) AS period, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2))""")
def q_trend(spark, d):
    """M6: daily counts per event type and change from the previous day."""
    return sm.trend(load(spark, d, "events"), "ts", "event_type", "day")


@register("timeline", """SELECT user_id, event_id, ts,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events""")
def q_timeline(spark, d):
    """M7: chronological order per user (skew-safe numbering)."""
    e = load(spark, d, "events").select("user_id", "event_id", "ts")
    return sm.timeline(e, "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "seq")


@register("theme_sources", sp.sql(sp.web_results(), """SELECT query_id, domain, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY query_id), 4) AS share FROM web_results GROUP BY query_id, domain"""))
def q_theme_sources(spark, d):
    """M8: sources (domains) per theme (request) with their share."""
    return sm.theme_sources(dv.web_results(spark, d), "query_id", "domain")


@register("extract_quotes", f"""SELECT doc_id, CAST(generate_subscripts(qs, 1) AS BIGINT) AS quote_pos, unnest(qs) AS quote
FROM (SELECT doc_id, regexp_extract_all(text, {sp.q(sm.QUOTE_PATTERN)}, 1) AS qs FROM documents)""")
def q_extract_quotes(spark, d):
    """Quoted spans with their document."""
    return sm.extract_quotes(_docs(spark, d, "text"), "doc_id")


@register("source_attribution", sp.sql(sp.web_tiered(), """SELECT query_id, url, CAST(count(*) AS BIGINT) AS n,
  CAST(min(tier) AS BIGINT) AS tier, max(nullif(published_date, '')) AS published_date
FROM web_tiered GROUP BY query_id, url"""))
def q_source_attribution(spark, d):
    """M8: urls behind each request's results with tier and date."""
    return sm.source_attribution(dv.web_tiered(spark, d), "query_id")


@register("render_themes", sp.sql(sp.doc_search() + sp.doc_sentences() + [_SUMMARY_SQL] + sp.web_images(), f"""SELECT t.query_id,
  t.md || chr(10) || chr(10) || '## Emerging Trends and Patterns' || chr(10) || coalesce(tr.md, '• none')
  || chr(10) || chr(10) || '## Visual Content Summary' || chr(10) || coalesce(v.md, '• none')
  || chr(10) || chr(10) || '## Data Gaps and Limitations' || chr(10) || coalesce(g.md, '• none') AS summary_md
FROM (SELECT query_id, string_agg('## Major Theme ' || CAST(k AS VARCHAR) || ': ' || source || chr(10) || b, chr(10) || chr(10) ORDER BY k) AS md
  FROM (SELECT query_id, source, b, row_number() OVER (PARTITION BY query_id ORDER BY r, p) AS k FROM (
    SELECT s.query_id, d.source, min(s.rank) AS r, arg_min(s.sent_pos, s.rank * 1000000 + s.sent_pos) AS p,
      string_agg('• ' || s.sentence || array_to_string(list_transform(
        regexp_extract_all(s.sentence, '[0-9]+(?:[.,:/-][0-9]+)*%?'), lambda f: chr(10) || '  ◦ ' || f), ''),
        chr(10) ORDER BY s.rank, s.sent_pos) AS b
    FROM summary s JOIN documents d ON d.doc_id = s.doc_id GROUP BY s.query_id, d.source)) GROUP BY query_id) t
LEFT JOIN (SELECT query_id, string_agg('• ' || fact || ' (' || CAST(n AS VARCHAR) || ' documents)', chr(10) ORDER BY n DESC, fact) AS md FROM (
  SELECT query_id, fact, count(DISTINCT doc_id) AS n FROM (SELECT query_id, doc_id,
    unnest(regexp_extract_all(sentence, '[0-9]+(?:[.,:/-][0-9]+)*%?')) AS fact FROM summary) GROUP BY ALL HAVING n >= 2)
  GROUP BY query_id) tr ON tr.query_id = t.query_id
LEFT JOIN (SELECT query_id, string_agg('• ' || description || ' <' || url || '>', chr(10) ORDER BY img_pos, url) AS md
  FROM web_images GROUP BY query_id) v ON v.query_id = t.query_id
LEFT JOIN (SELECT query_id, string_agg('• ' || term, chr(10) ORDER BY term) AS md FROM (SELECT DISTINCT query_id, term FROM
    (SELECT query_id, unnest({sp.tokens('query')}) AS term FROM params) e
  WHERE NOT EXISTS (SELECT 1 FROM doc_search s JOIN documents d ON d.doc_id = s.doc_id
    WHERE s.query_id = e.query_id AND list_contains({sp.tokens('d.text')}, e.term))) GROUP BY query_id) g ON g.query_id = t.query_id"""))
def q_render_themes(spark, d):
    """Themes (sources) with evidence (facts), repeated facts as trends,
    the pages' images and the query terms without evidence."""
    s = _summary(spark, d).join(_docs(spark, d, "source"), "doc_id")
    s = s.withColumn("evidence", F.regexp_extract_all("sentence", F.lit(sm.FACT_PATTERN), 0))
    told = (s.select("query_id", "doc_id", F.explode("evidence").alias("fact"))
            .groupBy("query_id", "fact").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 2"))
    section = lambda df, name, pos, line: df.select("query_id", F.lit(name).alias("section"),
                                                    F.struct(*pos).alias("pos"), line.alias("line"))
    extra = section(told, "trends", [(-F.col("n")).alias("a"), F.col("fact").alias("b")],
                    F.format_string("%s (%d documents)", "fact", "n"))
    extra = extra.unionByName(section(dv.web_images(spark, d), "visual", [F.col("img_pos").alias("a"), F.col("url").alias("b")],
                                      F.concat("description", F.lit(" <"), "url", F.lit(">"))))
    extra = extra.unionByName(section(q_coverage_gaps(spark, d), "gaps", [F.lit(0).cast("bigint").alias("a"), F.col("term").alias("b")],
                                      F.col("term")))
    return sm.render_themes(s, "query_id", "source", ["rank", "sent_pos"], extra)
