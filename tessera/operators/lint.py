"""Report lint and the quality decision.

Lint runs per report with row-local regex work; per-report aggregates are
grouped by ``report_id`` (one report's lines or citations at most).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_PATTERN, explode_rows
from tessera.operators.report import REFERENCES_HEADING, SECTION_ORDER

# --- fixed values (must equal the reference's rules) -----------------------
# Inline citation [n] not followed by "(" (a link), and the marker form.
CITATION_PATTERN = r"\[([0-9]+)\](?!\()"
MARKER_PATTERN = r"【([0-9]+):([0-9]+)†source】"
NUMBERED_REF = r"^([0-9]+)\. \[([^\]]*)\]\(([^)]*)\)(?: - (.*), (.*))?$"
BULLET_REF = r"^- \[([^\]]*)\]\(([^)]*)\)$"
UNLINKED_REF = r"^([0-9]+)\. (.*)$"
IMAGE_PATTERN = r"!\[[^\]]*\]\([^)]*\)"
EMPTY_ALT_IMAGE = r"!\[\]\([^)]*\)"
CAPTIONED_IMAGE = r"!\[[^\]]*\]\([^)]*\)\n\*Figure [0-9]+:[^\n]*\*"
HEADING_LEVELS = r"(?m)^(#+) "
REQUIRED_SECTIONS = SECTION_ORDER
MIN_WORDS, MAX_WORDS = 1200, 1500
MIN_IMAGES, MAX_IMAGES = 3, 5
# Quality weights and deductions.
W_CONTENT, W_CITATIONS, W_WRITING, W_VISUAL = 0.30, 0.35, 0.25, 0.10
D_NO_REFERENCES, D_ORPHANS, D_UNLINKED, D_SUPERFICIAL, D_FORMAT, D_IMAGES = 0.20, 0.15, 0.10, 0.10, 0.05, 0.05
# The content term is words / 4000 (5 decimals at most): quality is rounded
# to 6 places so no value sits on a rounding tie.
QUALITY_DIGITS = 6
# Quality bands (lower bound, name), best first.
BANDS = ((0.90, "exceptional"), (0.80, "excellent"), (0.75, "good"), (0.70, "fair"))
# Feedback priority: citations -> content -> formatting -> images.
FEEDBACK_PRIORITY = ("citations", "content", "formatting", "images")
# -----------------------------------------------------------------------------


def body_part(body: Column) -> Column:
    """Text before the references section."""
    return F.split_part(body, F.lit("\n" + REFERENCES_HEADING), F.lit(1))


def references_part(body: Column) -> Column:
    return F.split_part(body, F.lit(REFERENCES_HEADING + "\n"), F.lit(2))


def extract_citations(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """L1: inline ``[n]`` citations of the body (not links), in order, plus
    ``【a:b†source】`` markers (n = b).  Returns (report, cite_pos, n, kind)."""
    txt = body_part(F.col(body))
    inline = explode_rows(reports, [report], F.regexp_extract_all(txt, F.lit(CITATION_PATTERN), 1), "n",
                          pos="cite_pos").withColumn("kind", F.lit("inline"))
    marks = explode_rows(reports, [report], F.regexp_extract_all(txt, F.lit(MARKER_PATTERN), 2), "n",
                         pos="cite_pos").withColumn("kind", F.lit("marker"))
    # a run of digits beyond a bigint is no citation number
    return inline.unionByName(marks).select(report, (F.col("cite_pos") + 1).cast("bigint").alias("cite_pos"),
                                            F.col("n").try_cast("bigint").alias("n"), "kind").filter("n is not null")


def parse_references(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """L2: entries of the references section -> (report, line_no, n, title,
    url, publication, date, linked).  Bullet entries are numbered by position."""
    lines = F.split(references_part(F.col(body)), "\n")
    ex = explode_rows(reports, [report], lines, "line", pos="line_no").filter(F.col("line") != "")
    num = F.regexp_extract(F.col("line"), NUMBERED_REF, 1)
    bul_t = F.regexp_extract(F.col("line"), BULLET_REF, 1)
    is_num = F.col("line").rlike(NUMBERED_REF)
    is_bul = F.col("line").rlike(BULLET_REF)
    is_unl = ~is_num & ~is_bul & F.col("line").rlike(UNLINKED_REF)
    return ex.filter(is_num | is_bul | is_unl).select(
        report, (F.col("line_no") + 1).cast("bigint").alias("line_no"),
        F.when(is_num, num).when(is_unl, F.regexp_extract(F.col("line"), UNLINKED_REF, 1))
         .otherwise((F.col("line_no") + 1).cast("string")).try_cast("bigint").alias("n"),
        F.when(is_num, F.regexp_extract(F.col("line"), NUMBERED_REF, 2)).when(is_bul, bul_t)
         .otherwise(F.regexp_extract(F.col("line"), UNLINKED_REF, 2)).alias("title"),
        F.when(is_num, F.regexp_extract(F.col("line"), NUMBERED_REF, 3))
         .when(is_bul, F.regexp_extract(F.col("line"), BULLET_REF, 2)).alias("url"),
        F.when(is_num, F.regexp_extract(F.col("line"), NUMBERED_REF, 4)).alias("publication"),
        F.when(is_num, F.regexp_extract(F.col("line"), NUMBERED_REF, 5)).alias("date"),
        (is_num | is_bul).alias("linked"))


def orphan_citations(cites: DataFrame, refs: DataFrame, report: str = "report_id") -> DataFrame:
    """L3: cited numbers without a reference entry (distinct per report)."""
    return cites.select(report, "n").distinct().join(refs.select(report, "n"), [report, "n"], "left_anti")


def unused_references(cites: DataFrame, refs: DataFrame, report: str = "report_id") -> DataFrame:
    """L3: reference entries that are never cited."""
    return refs.select(report, "n").join(cites.select(report, "n"), [report, "n"], "left_anti").distinct()


def structure_check(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """L4: one ``#`` title, required ``##`` sections, 6-8 sections, ``###``
    under Key Findings."""
    b = F.col(body)
    titles = F.size(F.regexp_extract_all(b, F.lit(r"(?m)^# [^\n]*"), 0))
    present = F.regexp_extract_all(b, F.lit(r"(?m)^## ([^\n]*)"), 1)
    required = F.array(*[F.lit(s) for s in REQUIRED_SECTIONS])
    missing = F.array_except(required, present)
    kf = F.split_part(F.split_part(b, F.lit("## Key Findings\n"), F.lit(2)), F.lit("\n## "), F.lit(1))
    has_kf = F.instr(b, "## Key Findings\n") > 0
    sub = has_kf & (F.instr(F.concat(F.lit("\n"), kf), "\n### ") > 0)
    n_sec = F.size(present)
    return reports.select(
        report, titles.cast("bigint").alias("n_titles"), n_sec.cast("bigint").alias("n_sections"),
        F.array_join(missing, ",").alias("missing_sections"), sub.alias("kf_subsections"),
        ((titles == 1) & (F.size(missing) == 0) & n_sec.between(6, 8) & sub).alias("structure_ok"))


def body_length(txt: Column) -> Column:
    """Length in the unit of the dominant script: Han characters, else words."""
    return F.greatest(F.size(F.regexp_extract_all(txt, F.lit(r"\p{IsHan}"), 0)),
                      F.size(F.regexp_extract_all(txt, F.lit(TOKEN_PATTERN), 0)))


def length_check(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """1200-1500 words in the body; a body with more Han characters than
    words is Chinese and counted in characters."""
    txt = body_part(F.col(body))
    han = F.size(F.regexp_extract_all(txt, F.lit(r"\p{IsHan}"), 0))
    words = F.size(F.regexp_extract_all(txt, F.lit(TOKEN_PATTERN), 0))
    n = body_length(txt)
    return reports.select(report, words.cast("bigint").alias("n_words"), han.cast("bigint").alias("n_han"),
                          n.between(MIN_WORDS, MAX_WORDS).alias("length_ok"))


def reference_format(refs: DataFrame) -> DataFrame:
    """Title linked, publication and date present."""
    has_pub = F.coalesce(F.col("publication"), F.lit("")) != ""
    has_date = F.coalesce(F.col("date"), F.lit("")) != ""
    return refs.select("report_id", "n", "linked", has_pub.alias("has_publication"), has_date.alias("has_date"),
                       (F.col("linked") & has_pub & has_date).alias("format_ok"))


def image_check(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """Non-empty alt text, a caption line right after, 3-5 images."""
    b = F.col(body)

    def count(p):
        return F.size(F.regexp_extract_all(b, F.lit(p), 0)).cast("bigint")
    n = count(IMAGE_PATTERN)
    return reports.select(report, n.alias("n_images"), count(EMPTY_ALT_IMAGE).alias("n_empty_alt"),
                          count(CAPTIONED_IMAGE).alias("n_captioned"),
                          n.between(MIN_IMAGES, MAX_IMAGES).alias("count_ok"))


def uncited_sentences(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """Claim sentences (ours: containing a digit) without a citation,
    outside headings and the references section."""
    from tessera.operators.summarise import SENTENCE_PATTERN
    txt = body_part(F.col(body))
    s = F.regexp_extract_all(txt, F.lit(SENTENCE_PATTERN), 0)
    ex = explode_rows(reports, [report], s, "sentence", pos="sent_pos")
    claim = F.col("sentence").rlike("[0-9]") & ~F.col("sentence").rlike(CITATION_PATTERN) & \
        ~F.trim(F.col("sentence")).startswith("#")
    return ex.filter(claim).select(report, (F.col("sent_pos") + 1).cast("bigint").alias("sent_pos"),
                                   F.trim(F.col("sentence")).alias("sentence"))


def quality_score(checks: DataFrame) -> DataFrame:
    """Weighted components minus deductions, clamped to [0, 1].

    Component scores (ours): content = min(1, words / 1200); citations =
    1 - orphan share of cited numbers; writing = structure ok; visual =
    images ok (or 1.0 without images).  ``checks`` columns: n_words,
    n_cited, n_orphans, has_references, n_unlinked, structure_ok, n_titles,
    n_images, n_empty_alt, n_captioned.
    """
    content = F.least(F.lit(1.0), F.col("n_words") / F.lit(float(MIN_WORDS)))
    cites = F.when(F.col("n_cited") > 0, F.lit(1.0) - F.col("n_orphans") / F.col("n_cited")).otherwise(F.lit(0.0))
    writing = F.when(F.col("structure_ok"), F.lit(1.0)).otherwise(F.lit(0.5))
    img_bad = (F.col("n_images") > 0) & ((F.col("n_empty_alt") > 0) | (F.col("n_captioned") < F.col("n_images")))
    visual = F.when(img_bad, F.lit(0.5)).otherwise(F.lit(1.0))
    raw = (F.lit(W_CONTENT) * content + F.lit(W_CITATIONS) * cites + F.lit(W_WRITING) * writing
           + F.lit(W_VISUAL) * visual)
    ded = (F.when(~F.col("has_references"), F.lit(D_NO_REFERENCES)).otherwise(F.lit(0.0))
           + F.when(F.col("n_orphans") > 0, F.lit(D_ORPHANS)).otherwise(F.lit(0.0))
           + F.when(F.col("n_unlinked") > 0, F.lit(D_UNLINKED)).otherwise(F.lit(0.0))
           + F.when(F.col("n_words") < MIN_WORDS, F.lit(D_SUPERFICIAL)).otherwise(F.lit(0.0))
           + F.when(~F.col("structure_ok") | (F.col("n_titles") != 1), F.lit(D_FORMAT)).otherwise(F.lit(0.0))
           + F.when(img_bad, F.lit(D_IMAGES)).otherwise(F.lit(0.0)))
    return checks.select("*", F.round(content, 4).alias("content_score"), F.round(cites, 4).alias("citation_score"),
                         writing.alias("writing_score"), visual.alias("visual_score"),
                         F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - ded)), QUALITY_DIGITS).alias("quality"))


def quality_band(df: DataFrame, score: str = "quality") -> DataFrame:
    """Exceptional / excellent / good / fair / poor."""
    out = F.lit("poor")
    for lo, name in reversed(BANDS):
        out = F.when(F.col(score) >= lo, F.lit(name)).otherwise(out)
    return df.withColumn("band", out)


def feedback_list(issues: DataFrame, report: str = "report_id") -> DataFrame:
    """One feedback text per report, issues ordered citations ->
    content -> formatting -> images (then by message)."""
    prio = F.array_position(F.array(*[F.lit(p) for p in FEEDBACK_PRIORITY]), F.col("category"))
    s = F.struct(prio.alias("p"), F.col("message").alias("m"))
    return (issues.groupBy(report).agg(F.array_sort(F.collect_list(s)).alias("_a"))
            .select(report, F.array_join(F.transform("_a", lambda x: x["m"]), "; ").alias("feedback")))


def revision_delta(revisions: DataFrame, key: str = "thread_id", seq: str = "revision") -> DataFrame:
    """Per revision the score change and the issues fixed / introduced
    since the previous revision (previous row by an equi-join on seq - 1)."""
    from tessera.operators.sequence import with_previous
    r = with_previous(revisions, [key], seq, ["score", "issues"])
    prev_issues = F.coalesce(F.col("prev_issues"), F.array().cast("array<string>"))
    return r.select(key, seq, "score", F.round(F.col("score") - F.col("prev_score"), 4).alias("delta"),
                    F.array_join(F.array_sort(F.array_except(prev_issues, F.col("issues"))), ",").alias("fixed"),
                    F.array_join(F.array_sort(F.array_except(F.col("issues"), prev_issues)), ",").alias("introduced"))


def report_checks(reports: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """Every per-report input of L9 in one row-local pass (no explode, no
    join, no shuffle): word count, distinct cited numbers and orphans,
    references present / unlinked, structure and image checks.  Same values
    as aggregating L1-L7, which the registered lint queries do one by one."""
    b = F.col(body)
    txt = body_part(b)
    cited = F.array_distinct(F.transform(
        F.concat(F.regexp_extract_all(txt, F.lit(CITATION_PATTERN), 1),
                 F.regexp_extract_all(txt, F.lit(MARKER_PATTERN), 2)), lambda x: x.try_cast("bigint")))
    cited = F.filter(cited, lambda x: x.isNotNull())
    lines = F.split(references_part(b), "\n")

    def ref_no(line, i):
        return (F.when(line == "", F.lit(None).cast("bigint"))
                .when(line.rlike(NUMBERED_REF), F.regexp_extract(line, NUMBERED_REF, 1).try_cast("bigint"))
                .when(line.rlike(BULLET_REF), (i + 1).cast("bigint"))
                .when(line.rlike(UNLINKED_REF), F.regexp_extract(line, UNLINKED_REF, 1).try_cast("bigint")))
    refs = F.filter(F.transform(lines, ref_no), lambda x: x.isNotNull())
    unlinked = F.filter(lines, lambda l: (l != "") & ~l.rlike(NUMBERED_REF) & ~l.rlike(BULLET_REF)
                        & l.rlike(UNLINKED_REF))
    titles = F.size(F.regexp_extract_all(b, F.lit(r"(?m)^# [^\n]*"), 0))
    present = F.regexp_extract_all(b, F.lit(r"(?m)^## ([^\n]*)"), 1)
    missing = F.array_except(F.array(*[F.lit(x) for x in REQUIRED_SECTIONS]), present)
    kf = F.split_part(F.split_part(b, F.lit("## Key Findings\n"), F.lit(2)), F.lit("\n## "), F.lit(1))
    sub = (F.instr(b, "## Key Findings\n") > 0) & (F.instr(F.concat(F.lit("\n"), kf), "\n### ") > 0)
    n_sec = F.size(present)

    def count(p):
        return F.size(F.regexp_extract_all(b, F.lit(p), 0)).cast("bigint")
    return reports.select(
        report,
        body_length(txt).cast("bigint").alias("n_words"),
        F.size(cited).cast("bigint").alias("n_cited"),
        F.size(F.array_except(cited, refs)).cast("bigint").alias("n_orphans"),
        (F.instr(b, "\n" + REFERENCES_HEADING) > 0).alias("has_references"),
        F.size(unlinked).cast("bigint").alias("n_unlinked"),
        ((titles == 1) & (F.size(missing) == 0) & n_sec.between(6, 8) & sub).alias("structure_ok"),
        titles.cast("bigint").alias("n_titles"),
        count(IMAGE_PATTERN).alias("n_images"), count(EMPTY_ALT_IMAGE).alias("n_empty_alt"),
        count(CAPTIONED_IMAGE).alias("n_captioned"),
        F.array_join(missing, ",").alias("missing_sections"))
