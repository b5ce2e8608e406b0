"""Translation checks (TR1, TR2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
CITE_TOKEN = r"\[[0-9]+\](?!\()"
LINK_URL = r"\]\(([^)]*)\)"
IMAGE_URL = r"!\[[^\]]*\]\(([^)]*)\)"
HEADING_LEVEL = r"(?m)^(#+) "
# -----------------------------------------------------------------------------


def _multiset(c: Column, pattern: str, group: int) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(pattern), group))


def translation_integrity(pairs: DataFrame, src: str = "source_body", tgt: str = "target_body",
                          key: str = "report_id") -> DataFrame:
    """TR1: citations, urls and image urls as equal multisets; heading
    levels as an equal sequence."""
    s, t = F.col(src), F.col(tgt)
    cit = _multiset(s, CITE_TOKEN, 0) == _multiset(t, CITE_TOKEN, 0)
    url = _multiset(s, LINK_URL, 1) == _multiset(t, LINK_URL, 1)
    img = _multiset(s, IMAGE_URL, 1) == _multiset(t, IMAGE_URL, 1)
    hd = F.regexp_extract_all(s, F.lit(HEADING_LEVEL), 1) == F.regexp_extract_all(t, F.lit(HEADING_LEVEL), 1)
    return pairs.select(key, cit.alias("citations_ok"), url.alias("urls_ok"), img.alias("images_ok"),
                        hd.alias("headings_ok"), (cit & url & img & hd).alias("integrity_ok"))


def translation_needed(reports: DataFrame, done: DataFrame, key: str = "report_id", thread: str | None = None) -> DataFrame:
    """TR2: approved reports not in Chinese that have no translation yet
    (exactly once: the anti join against finished translations).

    With ``thread`` it is once for each thread: of a thread's approved reports the last (the largest
    ``key``) is its final one, and nothing is translated in a thread that has a translation (``done``
    then has the thread's column)."""
    if thread is not None:
        rest = [c for c in reports.columns if c != thread]
        last = (reports.filter("approved").groupBy(thread).agg(F.max_by(F.struct(*rest), key).alias("_r")).select(thread, "_r.*"))
        return last.filter(F.col("lang") != "zh").join(done.select(thread).distinct(), thread, "left_anti")
    todo = reports.filter(F.col("approved") & (F.col("lang") != "zh"))
    return todo.join(done.select(key), key, "left_anti")
