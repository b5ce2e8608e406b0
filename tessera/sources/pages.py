"""Raw web pages -> search-result fields (url, title, content, raw_content).

Pure regex projections, row-local.  HTML entities are left as they are.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import explode_rows

# --- fixed values ------------------------------------------------------------
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
# Blocks whose content is not page text.
NON_TEXT_BLOCKS = r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>"
COMMENT_PATTERN = r"(?s)<!--.*?-->"
TAG_PATTERN = r"<[^>]*>"
WS_PATTERN = r"\s+"
# Anchor links: href and anchor text (used as derived images / citations).
ANCHOR_PATTERN = r'<a href="([^"]*)">([^<]*)</a>'
# -----------------------------------------------------------------------------


def page_text(html_col: str = "html"):
    t = F.regexp_replace(F.col(html_col), COMMENT_PATTERN, " ")
    t = F.regexp_replace(t, NON_TEXT_BLOCKS, " ")
    t = F.regexp_replace(t, TAG_PATTERN, " ")
    return F.trim(F.regexp_replace(t, WS_PATTERN, " "))


def pages_to_results(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content): title from ``<title>``, content is the
    whole tag-stripped body text."""
    return pages.select(
        "page_id", "url",
        F.trim(F.regexp_extract(F.col("html"), TITLE_PATTERN, 1)).alias("title"),
        page_text("html").alias("content"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, anchor): every anchor of a page in document order."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR_PATTERN), 1)
    texts = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR_PATTERN), 2)
    zipped = pages.select("page_id", F.arrays_zip(hrefs.alias("href"), texts.alias("anchor")).alias("l"))
    return (explode_rows(zipped, ["page_id"], F.col("l"), "x", pos="pos")
            .select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"),
                    F.col("x.href").alias("href"), F.col("x.anchor").alias("anchor")))
