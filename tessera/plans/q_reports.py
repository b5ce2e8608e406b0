"""Registered queries: report assembly (W1-W6), lint and quality (L1-L10,
L12, L13) and translation checks (TR1, TR2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_PATTERN
from tessera.operators import dedup as dd
from tessera.operators import lint as ln
from tessera.operators import report as rp
from tessera.operators import translate as tl
from tessera.operators.sequence import sequence_number
from tessera.operators.summarise import SENTENCE_PATTERN
from tessera.plans import derived as dv
from tessera.plans import sqlparts as sp
from tessera.plans.catalog import register
from tessera.sources.pages import page_links
from tessera.sources.tables import load

Q = sp.q
NL = "chr(10)"
BODY_PART = f"split_part(body, {NL} || '## References', 1)"
REFS_PART = f"split_part(body, '## References' || {NL}, 2)"


# --- W1-W6 --------------------------------------------------------------------------
@register("join_parts", f"""SELECT conv_id AS thread_id, turn,
  array_to_string(list_transform(string_split(text, {NL}), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')),
                  {NL} || {NL}) AS body
FROM conversations WHERE role = 'assistant'""")
def q_join_parts(spark, d):
    """Assistant messages as text parts (one per line), stripped and
    joined by blank lines."""
    m = load(spark, d, "conversations").filter(F.col("role") == "assistant")
    parts = m.select(F.col("conv_id").alias("thread_id"), "turn", F.split(F.col("text"), "\n").alias("parts"))
    return rp.join_parts(parts).select("thread_id", "turn", "body")


def _annotations(spark, d):
    return page_links(load(spark, d, "pages")).select(
        F.col("page_id").alias("msg_id"), "pos", F.col("anchor").alias("title"), F.col("href").alias("url"))


@register("references_bullets", sp.sql(sp.page_links(), f"""SELECT msg_id,
  {NL} || {NL} || '## References' || {NL} || string_agg('- [' || title || '](' || url || ')' || {NL}, '' ORDER BY pos)
  AS references_md FROM (
  SELECT page_id AS msg_id, min(pos) AS pos, coalesce(nullif(arg_min(anchor, pos), ''), href) AS title, href AS url
  FROM page_links GROUP BY page_id, href) GROUP BY msg_id"""))
def q_references_bullets(spark, d):
    """Unique citations of a message as a References bullet list."""
    return rp.references_bullets(dd.unique_citations(_annotations(spark, d)))


@register("references_numbered", sp.sql(sp.page_links(), """SELECT page_id AS report_id, pos AS n,
  CAST(pos AS VARCHAR) || '. [' || anchor || '](' || href || ') - ' || split_part(href, '/', 2) || ', 2024-01-01'
  AS line FROM page_links"""))
def q_references_numbered(spark, d):
    """Numbered reference lines (publication from the link path, fixed date)."""
    refs = page_links(load(spark, d, "pages")).select(
        F.col("page_id").alias("report_id"), F.col("pos").alias("n"), F.col("anchor").alias("title"),
        F.col("href").alias("url"), F.split_part(F.col("href"), F.lit("/"), F.lit(2)).alias("publication"),
        F.lit("2024-01-01").alias("date"))
    return rp.references_numbered(refs).select("report_id", "n", "line")


@register("number_citations", sp.sql(sp.page_links(), """SELECT l.page_id AS report_id, l.href AS source, l.pos,
  CAST(f.number AS BIGINT) AS number FROM page_links l JOIN (
  SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY min(pos), href) AS number
  FROM page_links GROUP BY page_id, href) f ON f.page_id = l.page_id AND f.href = l.href"""))
def q_number_citations(spark, d):
    """Dense citation numbers by first appearance (page links as mentions)."""
    m = page_links(load(spark, d, "pages")).select(
        F.col("page_id").alias("report_id"), F.col("href").alias("source"), "pos")
    return rp.number_citations(m).select("report_id", "source", "pos", "number")


@register("assemble_report", sp.sql(sp.reports(), "SELECT report_id, lang, source, body FROM reports"))
def q_assemble_report(spark, d):
    """Reports assembled from documents (sections in fixed order)."""
    return dv.reports(spark, d)


@register("choose_images", sp.sql(sp.page_links(), """SELECT page_id AS report_id, CAST(rn AS BIGINT) AS figure_no,
  '![' || anchor || '](' || href || ')' AS markdown, '*Figure ' || CAST(rn AS VARCHAR) || ': ' || anchor || '*' AS caption
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM page_links) WHERE rn <= 5"""))
def q_choose_images(spark, d):
    """At most five figures per report with captions (page links as images)."""
    imgs = page_links(load(spark, d, "pages")).select(
        F.col("page_id").alias("report_id"), "pos", F.col("href").alias("url"), F.col("anchor").alias("alt"))
    return rp.choose_images(imgs)


# --- L1-L10, L12, L13 ------------------------------------------------------------------
_CITES = f"""cites AS (SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY p) AS BIGINT) AS cite_pos,
  CAST(regexp_extract(tok, '([0-9]+)', 1) AS BIGINT) AS n, 'inline' AS kind FROM (
  SELECT report_id, generate_subscripts(t, 1) AS p, unnest(t) AS tok FROM (
    SELECT report_id, regexp_extract_all({BODY_PART}, '\\[[0-9]+\\]\\(?') AS t FROM reports))
  WHERE NOT suffix(tok, '('))"""
NUM, BUL, UNL = Q(ln.NUMBERED_REF), Q(ln.BULLET_REF), Q(ln.UNLINKED_REF)
_REFS = f"""refs AS (SELECT report_id, line_no,
  CAST(CASE WHEN regexp_matches(line, {NUM}) THEN regexp_extract(line, {NUM}, 1)
            WHEN regexp_matches(line, {BUL}) THEN CAST(line_no AS VARCHAR)
            ELSE regexp_extract(line, {UNL}, 1) END AS BIGINT) AS n,
  CASE WHEN regexp_matches(line, {NUM}) THEN regexp_extract(line, {NUM}, 2)
       WHEN regexp_matches(line, {BUL}) THEN regexp_extract(line, {BUL}, 1)
       ELSE regexp_extract(line, {UNL}, 2) END AS title,
  CASE WHEN regexp_matches(line, {NUM}) THEN regexp_extract(line, {NUM}, 3)
       WHEN regexp_matches(line, {BUL}) THEN regexp_extract(line, {BUL}, 2) END AS url,
  CASE WHEN regexp_matches(line, {NUM}) THEN regexp_extract(line, {NUM}, 4) END AS publication,
  CASE WHEN regexp_matches(line, {NUM}) THEN regexp_extract(line, {NUM}, 5) END AS date,
  regexp_matches(line, {NUM}) OR regexp_matches(line, {BUL}) AS linked
FROM (SELECT report_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line FROM (
  SELECT report_id, string_split({REFS_PART}, {NL}) AS l FROM reports))
WHERE line <> '' AND (regexp_matches(line, {NUM}) OR regexp_matches(line, {BUL}) OR regexp_matches(line, {UNL})))"""
_REQ = "[" + ", ".join(Q(s) for s in ln.REQUIRED_SECTIONS) + "]"
_STRUCT = f"""struct AS (SELECT report_id, n_titles, CAST(len(present) AS BIGINT) AS n_sections,
  array_to_string(list_filter({_REQ}, lambda s: NOT list_contains(present, s)), ',') AS missing_sections,
  kf_subsections,
  n_titles = 1 AND len(list_filter({_REQ}, lambda s: NOT list_contains(present, s))) = 0
    AND len(present) BETWEEN 6 AND 8 AND kf_subsections AS structure_ok
FROM (SELECT report_id, CAST(len(regexp_extract_all(body, '(?m)^# [^\\n]*')) AS BIGINT) AS n_titles,
  regexp_extract_all(body, '(?m)^## ([^\\n]*)', 1) AS present,
  strpos(body, '## Key Findings' || {NL}) > 0 AND strpos({NL} || split_part(split_part(body, '## Key Findings' || {NL}, 2),
    {NL} || '## ', 1), {NL} || '### ') > 0 AS kf_subsections FROM reports))"""
_LEN = f"""lens AS (SELECT report_id, CAST(len(regexp_extract_all({BODY_PART}, {Q(TOKEN_PATTERN)})) AS BIGINT) AS n_words,
  CAST(len(regexp_extract_all({BODY_PART}, '\\p{{Han}}')) AS BIGINT) AS n_han FROM reports)"""
_IMG = f"""imgs AS (SELECT report_id, CAST(len(regexp_extract_all(body, {Q(ln.IMAGE_PATTERN)})) AS BIGINT) AS n_images,
  CAST(len(regexp_extract_all(body, {Q(ln.EMPTY_ALT_IMAGE)})) AS BIGINT) AS n_empty_alt,
  CAST(len(regexp_extract_all(body, {Q(ln.CAPTIONED_IMAGE)})) AS BIGINT) AS n_captioned FROM reports)"""
D = sp.dbl
_CHECKS = f"""checks AS (SELECT r.report_id, greatest(l.n_words, l.n_han) AS n_words,
  (SELECT CAST(count(DISTINCT n) AS BIGINT) FROM cites c WHERE c.report_id = r.report_id) AS n_cited,
  (SELECT CAST(count(DISTINCT c.n) AS BIGINT) FROM cites c WHERE c.report_id = r.report_id
     AND c.n NOT IN (SELECT f.n FROM refs f WHERE f.report_id = r.report_id)) AS n_orphans,
  strpos(r.body, {NL} || '## References') > 0 AS has_references,
  (SELECT CAST(count(*) AS BIGINT) FROM refs f WHERE f.report_id = r.report_id AND NOT f.linked) AS n_unlinked,
  s.structure_ok, s.n_titles, i.n_images, i.n_empty_alt, i.n_captioned
FROM reports r JOIN lens l ON l.report_id = r.report_id JOIN struct s ON s.report_id = r.report_id
JOIN imgs i ON i.report_id = r.report_id)"""
_SCORED = f"""scored AS (SELECT *, round(least({D(1.0)}, n_words / {D(1200.0)}), 4) AS content_score,
  round(CASE WHEN n_cited > 0 THEN {D(1.0)} - n_orphans / n_cited ELSE {D(0.0)} END, 4) AS citation_score,
  CASE WHEN structure_ok THEN {D(1.0)} ELSE {D(0.5)} END AS writing_score,
  CASE WHEN img_bad THEN {D(0.5)} ELSE {D(1.0)} END AS visual_score,
  round(greatest({D(0.0)}, least({D(1.0)},
    {D(0.3)} * least({D(1.0)}, n_words / {D(1200.0)})
    + {D(0.35)} * CASE WHEN n_cited > 0 THEN {D(1.0)} - n_orphans / n_cited ELSE {D(0.0)} END
    + {D(0.25)} * CASE WHEN structure_ok THEN {D(1.0)} ELSE {D(0.5)} END
    + {D(0.1)} * CASE WHEN img_bad THEN {D(0.5)} ELSE {D(1.0)} END
    - (CASE WHEN NOT has_references THEN {D(0.2)} ELSE {D(0.0)} END
       + CASE WHEN n_orphans > 0 THEN {D(0.15)} ELSE {D(0.0)} END
       + CASE WHEN n_unlinked > 0 THEN {D(0.1)} ELSE {D(0.0)} END
       + CASE WHEN n_words < 1200 THEN {D(0.1)} ELSE {D(0.0)} END
       + CASE WHEN NOT structure_ok OR n_titles <> 1 THEN {D(0.05)} ELSE {D(0.0)} END
       + CASE WHEN img_bad THEN {D(0.05)} ELSE {D(0.0)} END))), 6) AS quality
FROM (SELECT *, n_images > 0 AND (n_empty_alt > 0 OR n_captioned < n_images) AS img_bad FROM checks))"""
_LINT = sp.reports() + [_CITES, _REFS, _STRUCT, _LEN, _IMG, _CHECKS, _SCORED]


def _reports(spark, d):
    """Lint input: the derived reports, assembled row-locally (no shuffle);
    ``assemble_report`` checks the W5 path produces the same bodies."""
    return dv.reports_rowlocal(spark, d)


@register("extract_citations", sp.sql(sp.reports() + [_CITES], "SELECT report_id, cite_pos, n, kind FROM cites"))
def q_extract_citations(spark, d):
    """L1: inline citations of every report body."""
    return ln.extract_citations(_reports(spark, d))


@register("parse_references", sp.sql(sp.reports() + [_REFS],
                                     "SELECT report_id, line_no, n, title, url, publication, date, linked FROM refs"))
def q_parse_references(spark, d):
    """L2: reference entries of every report."""
    return ln.parse_references(_reports(spark, d))


@register("orphan_citations", sp.sql(sp.reports() + [_CITES, _REFS], """SELECT DISTINCT report_id, n FROM cites c
WHERE NOT EXISTS (SELECT 1 FROM refs f WHERE f.report_id = c.report_id AND f.n = c.n)"""))
def q_orphan_citations(spark, d):
    """L3: citations without a reference entry."""
    r = _reports(spark, d)
    return ln.orphan_citations(ln.extract_citations(r), ln.parse_references(r))


@register("unused_references", sp.sql(sp.reports() + [_CITES, _REFS], """SELECT DISTINCT report_id, n FROM refs f
WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.report_id = f.report_id AND c.n = f.n)"""))
def q_unused_references(spark, d):
    """L3: reference entries never cited."""
    r = _reports(spark, d)
    return ln.unused_references(ln.extract_citations(r), ln.parse_references(r))


@register("structure_check", sp.sql(sp.reports() + [_STRUCT], "SELECT * FROM struct"))
def q_structure_check(spark, d):
    """L4: title, sections, sub-sections."""
    return ln.structure_check(_reports(spark, d))


@register("length_check", sp.sql(sp.reports() + [_LEN], """SELECT report_id, n_words, n_han,
  CASE WHEN n_han > n_words THEN n_han ELSE n_words END BETWEEN 1200 AND 1500 AS length_ok FROM lens"""))
def q_length_check(spark, d):
    """Report length."""
    return ln.length_check(_reports(spark, d))


@register("reference_format", sp.sql(sp.reports() + [_REFS], """SELECT report_id, n, linked,
  coalesce(publication, '') <> '' AS has_publication, coalesce(date, '') <> '' AS has_date,
  linked AND coalesce(publication, '') <> '' AND coalesce(date, '') <> '' AS format_ok FROM refs"""))
def q_reference_format(spark, d):
    """Reference entries are links with publication and date."""
    return ln.reference_format(ln.parse_references(_reports(spark, d)))


@register("image_check", sp.sql(sp.reports() + [_IMG], """SELECT report_id, n_images, n_empty_alt, n_captioned,
  n_images BETWEEN 3 AND 5 AS count_ok FROM imgs"""))
def q_image_check(spark, d):
    """Image alt text, captions and count."""
    return ln.image_check(_reports(spark, d))


@register("uncited_sentences", sp.sql(sp.reports(), f"""SELECT report_id, sent_pos, trim(sentence) AS sentence FROM (
  SELECT report_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS sent_pos, unnest(s) AS sentence FROM (
    SELECT report_id, regexp_extract_all({BODY_PART}, {Q(SENTENCE_PATTERN)}) AS s FROM reports))
WHERE regexp_matches(sentence, '[0-9]') AND NOT regexp_matches(sentence, '\\[[0-9]+\\]([^(]|$)')
  AND NOT starts_with(trim(sentence), '#')"""))
def q_uncited_sentences(spark, d):
    """Claim sentences without citations."""
    return ln.uncited_sentences(_reports(spark, d))


def checks(spark, d):
    """Per-report lint results feeding L9, in one row-local pass over the
    assembled reports (no materialization, no joins)."""
    return ln.report_checks(_reports(spark, d))


_SCORE_COLS = "report_id, content_score, citation_score, writing_score, visual_score, quality"


@register("quality_score", sp.sql(_LINT, f"SELECT {_SCORE_COLS} FROM scored"))
def q_quality_score(spark, d):
    """Weighted quality with deductions."""
    return ln.quality_score(checks(spark, d).drop("missing_sections")).select(*_SCORE_COLS.split(", "))


_BAND_SQL = """CASE WHEN quality >= 0.9 THEN 'exceptional' WHEN quality >= 0.8 THEN 'excellent'
  WHEN quality >= 0.75 THEN 'good' WHEN quality >= 0.7 THEN 'fair' ELSE 'poor' END"""


@register("quality_band", sp.sql(_LINT, f"SELECT report_id, quality, {_BAND_SQL} AS band FROM scored"))
def q_quality_band(spark, d):
    """Quality band."""
    return ln.quality_band(ln.quality_score(checks(spark, d)).select("report_id", "quality"))


def issues(spark, d):
    c = checks(spark, d)
    rows = [
        (F.col("n_orphans") > 0, "citations", F.concat(F.lit("orphan citations: "), F.col("n_orphans").cast("string"))),
        (~F.col("has_references"), "citations", F.lit("missing references section")),
        (F.col("n_words") < 1200, "content", F.concat(F.lit("too short: "), F.col("n_words").cast("string"),
                                                        F.lit(" words"))),
        (F.col("missing_sections") != "", "formatting", F.concat(F.lit("missing sections: "), F.col("missing_sections"))),
        (F.col("n_empty_alt") > 0, "images", F.lit("image without alt text")),
    ]
    arr = F.array(*[F.when(cond, F.struct(F.lit(cat).alias("category"), msg.alias("message"))) for cond, cat, msg in rows])
    return (c.select("report_id", F.explode(F.array_compact(arr)).alias("i"))
            .select("report_id", "i.category", "i.message"))


@register("feedback_list", sp.sql(_LINT, f"""SELECT report_id, string_agg(message, '; ' ORDER BY p, message) AS feedback FROM (
  SELECT c.report_id, 1 AS p, 'orphan citations: ' || CAST(n_orphans AS VARCHAR) AS message FROM checks c WHERE n_orphans > 0
  UNION ALL SELECT report_id, 1, 'missing references section' FROM checks WHERE NOT has_references
  UNION ALL SELECT report_id, 2, 'too short: ' || CAST(n_words AS VARCHAR) || ' words' FROM checks WHERE n_words < 1200
  UNION ALL SELECT report_id, 3, 'missing sections: ' || missing_sections FROM struct WHERE missing_sections <> ''
  UNION ALL SELECT report_id, 4, 'image without alt text' FROM checks WHERE n_empty_alt > 0)
GROUP BY report_id"""))
def q_feedback_list(spark, d):
    """Prioritised feedback per report."""
    return ln.feedback_list(issues(spark, d))


def revisions(spark, d):
    """Assistant messages as successive revisions of a thread's report."""
    m = load(spark, d, "conversations").filter(F.col("role") == "assistant")
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0))
    iss = F.array_compact(F.array(F.when(words < 250, F.lit("short")),
                                  F.when(~F.col("text").rlike("[0-9]"), F.lit("no_numbers")),
                                  F.when(F.size(F.split(F.col("text"), "\n")) < 2, F.lit("single_paragraph"))))
    r = m.select(F.col("conv_id").alias("thread_id"), "turn",
                 F.round(F.least(F.lit(1.0), words / F.lit(250.0)), 4).alias("score"), iss.alias("issues"))
    return sequence_number(r, ["thread_id"], ["turn"], out="revision").drop("turn")


@register("revision_delta", f"""WITH r AS (SELECT conv_id AS thread_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS revision,
  round(least(1.0, len(regexp_extract_all(text, {Q(TOKEN_PATTERN)})) / 250.0), 4) AS score,
  list_filter(['short', 'no_numbers', 'single_paragraph'], lambda x:
    (x = 'short' AND len(regexp_extract_all(text, {Q(TOKEN_PATTERN)})) < 250)
    OR (x = 'no_numbers' AND NOT regexp_matches(text, '[0-9]'))
    OR (x = 'single_paragraph' AND len(string_split(text, {NL})) < 2)) AS issues
  FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, lag(score) OVER (PARTITION BY thread_id ORDER BY revision) AS prev_score,
  coalesce(lag(issues) OVER (PARTITION BY thread_id ORDER BY revision), []::VARCHAR[]) AS prev_issues FROM r)
SELECT thread_id, revision, score, round(score - prev_score, 4) AS delta,
  array_to_string(list_sort(list_filter(prev_issues, lambda x: NOT list_contains(issues, x))), ',') AS fixed,
  array_to_string(list_sort(list_filter(issues, lambda x: NOT list_contains(prev_issues, x))), ',') AS introduced
FROM p""")
def q_revision_delta(spark, d):
    """Score change and issues fixed / introduced per revision."""
    return ln.revision_delta(revisions(spark, d))


# --- TR1, TR2 ------------------------------------------------------------------------
def translation_pairs(spark, d):
    """Source report and a derived translation (' the ' -> ' le '), with
    seeded defects: a dropped citation, demoted sub-headings, moved images."""
    r = _reports(spark, d)
    i = F.col("report_id")
    t = F.replace(F.col("body"), F.lit(" the "), F.lit(" le "))
    t = F.when(i % 3 == 0, F.regexp_replace(t, r"\[1\]", "")).otherwise(t)
    t = F.when(i % 5 == 1, F.replace(t, F.lit("### "), F.lit("## "))).otherwise(t)
    t = F.when(i % 11 == 0, F.replace(t, F.lit("https://img.example.org/"), F.lit("https://img.example.com/"))).otherwise(t)
    return r.select("report_id", "lang", F.col("body").alias("source_body"), t.alias("target_body"))


def _ms_sql(x: str, kind: str) -> str:
    if kind == "cite":
        return f"list_sort(list_filter(regexp_extract_all({x}, '\\[[0-9]+\\]\\(?'), lambda c: NOT suffix(c, '(')))"
    if kind == "url":
        return f"list_sort(regexp_extract_all({x}, {Q(tl.LINK_URL)}, 1))"
    return f"list_sort(regexp_extract_all({x}, {Q(tl.IMAGE_URL)}, 1))"


_PAIRS = """pairs AS (SELECT report_id, lang, body AS source_body, CASE WHEN report_id % 11 = 0
  THEN replace(t2, 'https://img.example.org/', 'https://img.example.com/') ELSE t2 END AS target_body FROM (
  SELECT *, CASE WHEN report_id % 5 = 1 THEN replace(t1, '### ', '## ') ELSE t1 END AS t2 FROM (
  SELECT *, CASE WHEN report_id % 3 = 0 THEN regexp_replace(t0, '\\[1\\]', '', 'g') ELSE t0 END AS t1 FROM (
  SELECT *, replace(body, ' the ', ' le ') AS t0 FROM reports))))"""


@register("translation_integrity", sp.sql(sp.reports() + [_PAIRS], f"""SELECT report_id,
  {_ms_sql('source_body', 'cite')} = {_ms_sql('target_body', 'cite')} AS citations_ok,
  {_ms_sql('source_body', 'url')} = {_ms_sql('target_body', 'url')} AS urls_ok,
  {_ms_sql('source_body', 'img')} = {_ms_sql('target_body', 'img')} AS images_ok,
  regexp_extract_all(source_body, {Q(tl.HEADING_LEVEL)}, 1) = regexp_extract_all(target_body, {Q(tl.HEADING_LEVEL)}, 1)
    AS headings_ok FROM pairs"""))
def q_translation_integrity(spark, d):
    """TR1: citations, links, images and heading levels survive translation."""
    return tl.translation_integrity(translation_pairs(spark, d)).drop("integrity_ok")


def _approved(spark, d):
    """(report_id, lang, approved): quality >= 0.70.  Written once: a filter on it would else go down into
    the lint of the report, which is then done for the filter and for each column again."""
    from tessera.session import materialize
    q = ln.quality_score(checks(spark, d)).select("report_id", (F.col("quality") >= 0.7).alias("approved"))
    return _reports(spark, d).select("report_id", "lang").join(materialize(q, "approved"), "report_id")


@register("translation_needed", sp.sql(_LINT, """SELECT s.report_id FROM scored s JOIN reports r ON r.report_id = s.report_id
WHERE s.quality >= 0.7 AND r.lang <> 'zh' AND s.report_id % 9 <> 0"""))
def q_translation_needed(spark, d):
    """TR2: approved (quality >= 0.70, the last-iteration threshold) reports
    not in Chinese and not yet translated (ids divisible by 9 are done)."""
    r = _approved(spark, d)
    done = r.filter(F.col("report_id") % 9 == 0).select("report_id")
    return tl.translation_needed(r, done).select("report_id")


@register("translation_per_thread", sp.sql(_LINT, """SELECT thread_id, report_id FROM (SELECT s.report_id // 5 AS thread_id, max(s.report_id) AS report_id,
  arg_max(r.lang, s.report_id) AS lang FROM scored s JOIN reports r ON r.report_id = s.report_id WHERE s.quality >= 0.7 GROUP BY 1)
WHERE lang <> 'zh' AND thread_id NOT IN (SELECT report_id // 5 FROM reports WHERE report_id % 45 = 0)"""))
def q_translation_per_thread(spark, d):
    """TR2 once for each thread (five reports to a thread; those with a report whose id is divisible by
    45 have their translation)."""
    r = _approved(spark, d).withColumn("thread_id", F.expr("report_id div 5"))
    done = r.filter(F.col("report_id") % 45 == 0).select("thread_id")
    return tl.translation_needed(r, done, thread="thread_id").select("thread_id", "report_id")
