"""Report assembly.

Every collected list here is bounded by one report (its sections, its
citations, its images), never by the corpus.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_ws

# --- fixed values (must equal the reference's rules) -----------------------
REFERENCES_HEADING = "## References"
# Section order of a report (References last).
SECTION_ORDER = ("Introduction", "Background", "Key Findings", "Analysis",
                 "Implications", "Conclusion", "References")
MAX_IMAGES = 5
# -----------------------------------------------------------------------------


def join_parts(df: DataFrame, parts: str = "parts", trimmed: bool = True) -> DataFrame:
    """Final text = parts stripped and joined by a blank line (display
    variant: untrimmed, joined by a single newline)."""
    if trimmed:
        return df.withColumn("body", F.array_join(F.transform(F.col(parts), lambda p: strip_ws(p)), "\n\n"))
    return df.withColumn("body", F.array_join(F.col(parts), "\n"))


def references_bullets(citations: DataFrame, msg: str = "msg_id") -> DataFrame:
    """W2: "\\n\\n## References\\n" then one "- [title](url)\\n" per unique
    citation in first-occurrence order; messages without citations get none.

    ``citations`` is the output of ``dedup.unique_citations``.
    """
    s = F.struct(F.col("pos"), F.format_string("- [%s](%s)\n", F.col("title"), F.col("url")).alias("line"))
    return (citations.groupBy(msg).agg(F.array_sort(F.collect_list(s)).alias("_a"))
            .select(msg, F.concat(F.lit("\n\n" + REFERENCES_HEADING + "\n"),
                                  F.array_join(F.transform("_a", lambda x: x["line"]), "")).alias("references_md")))


def references_numbered(refs: DataFrame) -> DataFrame:
    """``n. [Title](URL) - Publication, Date``."""
    return refs.withColumn("line", F.format_string("%d. [%s](%s) - %s, %s", F.col("n"), F.col("title"),
                                                   F.col("url"), F.col("publication"), F.col("date")))


def number_citations(mentions: DataFrame, report: str = "report_id", source: str = "source",
                     pos: str = "pos") -> DataFrame:
    """Dense citation numbers by first appearance per report; repeated
    sources reuse their number."""
    first = mentions.groupBy(report, source).agg(F.min(pos).alias("_first"))
    w = Window.partitionBy(report).orderBy("_first", source)
    nums = first.withColumn("number", F.row_number().over(w).cast("bigint")).drop("_first")
    return mentions.join(nums, [report, source])


def assemble_report(sections: DataFrame, titles: DataFrame, report: str = "report_id") -> DataFrame:
    """``# title``, then each present section as ``## name`` + its
    paragraphs (in order), sections in the fixed order; missing sections
    are omitted (the structure lint reports them).

    ``sections``: (report, section, para_pos, para, [subheading]);
    ``titles``: (report, title).
    """
    order = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section"))
    per = (sections.groupBy(report, "section")
           .agg(F.array_sort(F.collect_list(F.struct("para_pos", "para"))).alias("_p"))
           .select(report, order.alias("_o"), "section",
                   F.array_join(F.transform("_p", lambda x: x["para"]), "\n\n").alias("_body")))
    block = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("_body"))
    rep = (per.groupBy(report).agg(F.array_sort(F.collect_list(F.struct(F.col("_o"), block.alias("b")))).alias("_s"))
           .select(report, F.array_join(F.transform("_s", lambda x: x["b"]), "\n\n").alias("_sections")))
    return (titles.join(rep, report)
            .select(report, F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("_sections")).alias("body")))


def choose_images(images: DataFrame, report: str = "report_id", order: str = "pos",
                  limit: int = MAX_IMAGES) -> DataFrame:
    """At most ``limit`` images per report (literal bound: planned with a
    partial WindowGroupLimit), each with an ``*Figure X: alt*`` caption."""
    w = Window.partitionBy(report).orderBy(order)
    return (images.withColumn("figure_no", F.row_number().over(w))
            .filter(F.col("figure_no") <= limit)
            .select(report, F.col("figure_no").cast("bigint").alias("figure_no"),
                    F.format_string("![%s](%s)", F.col("alt"), F.col("url")).alias("markdown"),
                    F.format_string("*Figure %d: %s*", F.col("figure_no"), F.col("alt")).alias("caption")))
