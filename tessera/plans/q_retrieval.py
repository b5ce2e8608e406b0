"""Registered queries: sources, request planning, retrieval, normalisation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import extract_domain, truncate_text
from tessera.operators import normalise as nz
from tessera.operators import requests as rq
from tessera.operators import summarise as sm
from tessera.plans import derived as dv
from tessera.plans import sqlparts as sp
from tessera.plans.catalog import register
from tessera.sources.pages import page_links
from tessera.sources.tables import corpus, load


@register("corpus", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_corpus(spark, d):
    """The corpus with its schema enforced."""
    return corpus(spark, d)


@register("search_params", sp.sql(sp.params(), "SELECT * FROM params"))
def q_search_params(spark, d):
    """Q1: parameter building for every request."""
    return dv.params(spark, d)


@register("keyword_search", sp.sql(sp.doc_search(), "SELECT query_id, rank, doc_id, score FROM doc_search"))
def q_keyword_search(spark, d):
    """R1 + R6: BM25 over documents, capped by max_results."""
    return dv.doc_search(spark, d).select("query_id", "rank", "doc_id", "score")


@register("pages_to_results", sp.sql(sp.page_results(), "SELECT page_id, url, title, content FROM page_results"))
def q_pages_to_results(spark, d):
    """Page adapter."""
    return dv.page_results(spark, d)


@register("normalise_results", sp.sql(sp.web_results(), "SELECT * FROM web_results"))
def q_normalise_results(spark, d):
    """N1 (+N2, N3): web search results normalised (crawled_at excluded)."""
    return dv.web_results(spark, d)


@register("extract_domain", f"SELECT page_id, url, {sp.domain('url')} AS domain FROM pages")
def q_extract_domain(spark, d):
    """Netloc of every page url."""
    return load(spark, d, "pages").select("page_id", "url", extract_domain("url").alias("domain"))


@register("truncate_text", f"""SELECT doc_id, {sp.truncate('text', 1000)} AS text_1000,
  {sp.truncate('text', 500)} AS text_500, {sp.truncate('text', 50)} AS text_50 FROM documents""")
def q_truncate_text(spark, d):
    """Truncation at the three lengths the reference uses."""
    return load(spark, d, "documents").select(
        "doc_id", truncate_text("text", 1000).alias("text_1000"),
        truncate_text("text", 500).alias("text_500"), truncate_text("text", 50).alias("text_50"))


def flagship(spark, d):
    """entry(): search + snippet for the top results of every request."""
    hits = dv.doc_search(spark, d)
    docs = load(spark, d, "documents").select("doc_id", "text")
    return (hits.join(docs, "doc_id")
            .select("query_id", "rank", "doc_id", "score",
                    truncate_text("text", 1000).alias("snippet")))


@register("search_with_snippet", sp.sql(sp.doc_search(), f"""SELECT h.query_id, h.rank, h.doc_id, h.score,
  {sp.truncate('d.text', 1000)} AS snippet FROM doc_search h JOIN documents d ON d.doc_id = h.doc_id"""))
def q_search_with_snippet(spark, d):
    """The flagship slice (Q1 -> R1 -> R6 -> N3) as a registered query."""
    return flagship(spark, d)


# --- S2, N4-N10 ---------------------------------------------------------------
from tessera.sources import responses as rs  # noqa: E402
from tessera.operators import dedup as dd  # noqa: E402

PARSED_COLS = ("query_id", "rank", "url", "title", "content", "score", "published_date",
               "raw_content", "has_url", "has_title", "has_content")


@register("parse_responses_results", sp.sql(sp.parsed_results(), f"SELECT {', '.join(PARSED_COLS)} FROM parsed"))
def q_parse_results(spark, d):
    """Result rows of the JSON responses."""
    return rs.parse_results(dv.responses(spark, d)).select(*PARSED_COLS)


@register("parse_responses_errors", sp.sql(sp.parsed_results(), "SELECT query_id, error FROM parsed_errors"))
def q_parse_errors(spark, d):
    """Error rows (bad JSON, non-object response)."""
    return rs.parse_errors(dv.responses(spark, d))


@register("validate_batches", sp.sql(sp.parsed_results(), """SELECT r.query_id,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_results, coalesce(p.n, 0) > 0 AND coalesce(p.ok, FALSE) AS valid
FROM resp r LEFT JOIN (SELECT query_id, count(*) AS n, bool_and(has_url AND has_title AND has_content) AS ok
  FROM parsed GROUP BY query_id) p ON p.query_id = r.query_id"""))
def q_validate_batches(spark, d):
    """Batch verdicts for every response, empty batches included."""
    resp = dv.responses(spark, d)
    return nz.validate_batches(resp, rs.parse_results(resp))


@register("quarantine", sp.sql(sp.parsed_results(), """SELECT query_id, rank,
  CASE WHEN NOT has_url THEN 'missing url' WHEN NOT has_title THEN 'missing title'
       WHEN NOT has_content THEN 'missing snippet' END AS reason,
  CASE WHEN has_url AND has_title AND has_content THEN 'valid' ELSE 'rejected' END AS status
FROM parsed"""))
def q_quarantine(spark, d):
    """Row-level valid / rejected split."""
    return nz.quarantine(rs.parse_results(dv.responses(spark, d))).select("query_id", "rank", "reason", "status")


@register("error_rows", sp.sql(sp.parsed_results(), """SELECT r.query_id, e.error,
  CASE WHEN e.error IS NULL THEN 'ok' ELSE 'error' END AS status
FROM resp r LEFT JOIN parsed_errors e ON e.query_id = r.query_id"""))
def q_error_rows(spark, d):
    """One status row per request."""
    resp = dv.responses(spark, d)
    return nz.error_rows(resp, rs.parse_errors(resp))


@register("attach_images", sp.sql(sp.web_results() + sp.web_images(), """SELECT w.query_id, w.rank, w.page_id,
  i.n_images, i.images_md
FROM web_results w LEFT JOIN (
  SELECT query_id, CAST(1 AS BIGINT) AS rank, CAST(count(*) AS BIGINT) AS n_images,
         string_agg('![' || description || '](' || url || ')', chr(10) ORDER BY img_pos) AS images_md
  FROM web_images
  WHERE coalesce(url, '') <> '' AND coalesce(description, '') <> ''
    AND query_id IN (SELECT query_id FROM params WHERE include_images)
  GROUP BY query_id) i ON i.query_id = w.query_id AND i.rank = w.rank"""))
def q_attach_images(spark, d):
    """Images of image-enabled requests attached to their first result."""
    out = nz.attach_images(dv.web_results(spark, d).select("query_id", "rank", "page_id"),
                           dv.web_images(spark, d), params=dv.params(spark, d))
    return out.select("query_id", "rank", "page_id",
                      F.when(F.col("images").isNotNull(), F.size("images").cast("bigint")).alias("n_images"),
                      F.array_join(F.transform("images", lambda x: x["markdown"]), "\n").alias("images_md"))


@register("result_count_check", sp.sql(sp.doc_search(), """SELECT p.query_id,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_results, NOT (coalesce(c.n, 0) BETWEEN 20 AND 50) AS out_of_range
FROM params p LEFT JOIN (SELECT query_id, count(*) AS n FROM doc_search GROUP BY query_id) c
  ON c.query_id = p.query_id"""))
def q_result_count_check(spark, d):
    """Requests outside 20-50 results."""
    return nz.result_count_check(dv.doc_search(spark, d), dv.params(spark, d))


@register("field_profile", sp.sql(sp.web_results(), """SELECT query_id, CAST(count(*) AS BIGINT) AS n_results,
  CAST(count(*) FILTER (WHERE coalesce(title, '') <> '') AS BIGINT) AS n_titled,
  round(avg(length(snippet)), 4) AS avg_snippet_len,
  CAST(count(*) FILTER (WHERE raw_content IS NULL) AS BIGINT) AS n_raw_null,
  round(avg(length(raw_content)), 4) AS avg_raw_len
FROM web_results GROUP BY query_id"""))
def q_field_profile(spark, d):
    """Per-query field report."""
    return nz.field_profile(dv.web_results(spark, d))


@register("image_request_check", sp.sql(sp.web_images(), """SELECT query_id, 'no_images' AS issue, CAST(1 AS BIGINT) AS n
FROM params WHERE include_images AND query_id NOT IN (SELECT query_id FROM web_images
  WHERE coalesce(url, '') <> '' AND coalesce(description, '') <> '')
UNION ALL
SELECT query_id, issue, CAST(count(*) AS BIGINT) FROM (
  SELECT query_id, 'empty_url' AS issue FROM web_images WHERE coalesce(url, '') = ''
  UNION ALL SELECT query_id, 'empty_description' FROM web_images WHERE coalesce(description, '') = '')
GROUP BY query_id, issue"""))
def q_image_request_check(spark, d):
    """Image requests without usable images; empty image fields."""
    return nz.image_request_check(dv.params(spark, d), dv.web_images(spark, d))


@register("results_to_json")
def q_results_to_json(spark, d):
    """S3: one JSON array per request (rows-only check: JSON text formatting
    differs between engines)."""
    return rs.results_to_json(dv.web_results(spark, d))


@register("results_json_rows", sp.sql(sp.web_results(), """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS pos,
  url, title, snippet, score, published_date, domain FROM web_results"""))
def q_results_json_rows(spark, d):
    """S3: the JSON text of each request read back: its elements in their order, text unchanged."""
    element = "array<struct<url string, title string, snippet string, score double, published_date string, domain string>>"
    back = rs.results_to_json(dv.web_results(spark, d)).select("query_id", F.posexplode(F.from_json("json", element)).alias("pos", "r"))
    return back.select("query_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "r.*")


@register("summary_theme_flags", sp.sql(sp.doc_search() + sp.doc_sentences() + ["""theme_sent AS (SELECT s.query_id, d.source AS theme, s.rank, t.sent_pos, t.n_tokens,
  CAST(sum(t.n_tokens) OVER (PARTITION BY s.query_id, d.source ORDER BY s.rank, t.sent_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_tokens
  FROM doc_search s JOIN documents d ON d.doc_id = s.doc_id JOIN doc_sent t ON t.doc_id = s.doc_id)"""],
    """SELECT query_id, theme, CAST(sum(n_tokens) AS BIGINT) AS summary_tokens, CAST(count(*) AS BIGINT) AS n_sentences,
  sum(n_tokens) < 800 AS too_short FROM theme_sent WHERE running_tokens <= 1200 GROUP BY query_id, theme"""))
def q_summary_theme_flags(spark, d):
    """M4 by theme: each theme of a request is summarised within the budget, those under 800 tokens are flagged."""
    hits = dv.doc_search(spark, d).select("query_id", "rank", "doc_id").join(
        load(spark, d, "documents").select("doc_id", F.col("source").alias("theme"), "text"), "doc_id")
    sents = sm.sentences(hits.select("doc_id", "text").distinct(), "doc_id")
    picked = sm.extractive_summary(hits.drop("text").join(sents, "doc_id"), ["query_id", "theme"], ["rank", "sent_pos"])
    return sm.summary_flags(picked, ["query_id", "theme"])


# --- D1, D2, D4, D5 -------------------------------------------------------------
@register("unique_citations", sp.sql(sp.page_links(), """SELECT page_id AS msg_id, min(pos) AS pos,
  coalesce(nullif(arg_min(anchor, pos), ''), href) AS title, href AS url
FROM page_links GROUP BY page_id, href"""))
def q_unique_citations(spark, d):
    """First occurrence of each url per message (page anchors as citations)."""
    ann = page_links(load(spark, d, "pages")).select(F.col("page_id").alias("msg_id"), "pos", F.col("anchor").alias("title"), F.col("href").alias("url"))
    return dd.unique_citations(ann)


@register("drop_exact_duplicates", """SELECT d.doc_id, d.lang, d.source, d.n_chars, k.n_copies
FROM documents d JOIN (SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_copies
  FROM documents GROUP BY text) k ON k.doc_id = d.doc_id""")
def q_drop_exact_duplicates(spark, d):
    """One document per distinct text."""
    return dd.drop_exact_duplicates(load(spark, d, "documents")).select(
        "doc_id", "lang", "source", "n_chars", "n_copies")


@register("diversify", sp.sql(sp.web_results(), """SELECT query_id, rank, page_id, domain, domain_rank FROM (
  SELECT query_id, rank, page_id, domain, CAST(row_number() OVER (PARTITION BY query_id, domain
    ORDER BY score DESC, page_id) AS BIGINT) AS domain_rank FROM web_results) WHERE domain_rank <= 2"""))
def q_diversify(spark, d):
    """At most two results per domain and request."""
    return dd.diversify(dv.web_results(spark, d)).select("query_id", "rank", "page_id", "domain", "domain_rank")


@register("source_mix", """SELECT source, lang, CAST(count(*) AS BIGINT) AS n,
  CAST(grouping(source, lang) AS BIGINT) AS level,
  round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM documents), 4) AS share
FROM documents GROUP BY ROLLUP (source, lang)""")
def q_source_mix(spark, d):
    """Documents by source and language with rollup subtotals."""
    return dd.source_mix(load(spark, d, "documents").select("source", "lang"))


@register("source_balance", """SELECT CAST(count(*) AS BIGINT) AS n_groups,
  round(max(n) / (SELECT CAST(count(*) AS DOUBLE) FROM documents), 4) AS max_share
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def q_source_balance(spark, d):
    """Language balance (largest share)."""
    return dd.balance(load(spark, d, "documents").select("lang"), "lang")


@register("near_duplicates", r"""WITH w AS (SELECT doc_id,
  string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
  THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  ELSE [array_to_string(ws, ' ')] END) AS s FROM w WHERE ws[1] <> ''),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT x, y, c / CAST(nx.n + ny.n - c AS DOUBLE) AS jac FROM p
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y)
SELECT y AS doc_id, min(x) AS dup_of, round(arg_min(jac, x), 4) AS jaccard FROM j WHERE jac >= 0.8 GROUP BY y""")
def q_near_duplicates(spark, d):
    """D3: near-duplicate documents (MinHash LSH, exact verification); the
    oracle compares all pairs."""
    return dd.near_duplicates(load(spark, d, "documents"))


# --- Q2-Q6 ------------------------------------------------------------------------------
def _case_time_range() -> str:
    widths = {"day": 1, "week": 7, "month": 30, "year": 365}
    parts = ", ".join(f"CASE WHEN list_contains(t, {sp.q(c)}) THEN {widths.get(r, 10 ** 6)} END"
                      for c, r in rq.TIME_CUES)
    back = " ".join(f"WHEN {w} THEN {sp.q(r)}" for r, w in widths.items())
    return f"CASE least({parts}) {back} END"


@register("expand_queries", sp.sql(sp.params(), """SELECT query_id, a.angle, CAST(a.pos AS BIGINT) AS angle_pos,
  query || a.suffix AS query FROM params CROSS JOIN (VALUES ('primary', 0, ''), ('aspect', 1, ' analysis'),
  ('alternative', 2, ' overview')) a(angle, pos, suffix)"""))
def q_expand_queries(spark, d):
    """Q2: primary / aspect / alternative wording per request."""
    return rq.expand_queries(dv.params(spark, d).select("query_id", "query")).select(
        "query_id", "angle", "angle_pos", "query")


@register("infer_request_rules", sp.sql(sp.requests(), f"""SELECT query_id, {_case_time_range()} AS inferred_time_range,
  CASE {' '.join(f"WHEN list_contains(t, {sp.q(c)}) THEN {sp.q(v)}" for c, v in rq.TOPIC_CUES)} ELSE 'general' END
    AS inferred_topic,
  coalesce(include_images, FALSE) OR list_has_any(t, [{', '.join(sp.q(c) for c in rq.VISUAL_CUES)}]) AS wants_images,
  CASE WHEN regexp_matches(query, '\\p{{Han}}') THEN 'zh' ELSE 'en' END AS report_lang
FROM (SELECT *, {sp.tokens('query')} AS t FROM requests)"""))
def q_infer_request_rules(spark, d):
    """Q3-Q6: time range, topic, image need and report language inferred
    from every request's text."""
    r = dv.requests(spark, d)
    out = rq.detect_script(rq.wants_images(rq.infer_topic(rq.infer_time_range(r))))
    return out.select("query_id", "inferred_time_range", "inferred_topic", "wants_images", "report_lang")
