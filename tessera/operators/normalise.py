"""Normalise and validate search results.

Per-query checks aggregate by ``query_id`` with partial (map-side)
aggregation; batch-level verdicts are joined back from the request list so
that empty batches are reported instead of silently disappearing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import extract_domain, truncate_text

# --- fixed values (must equal the reference's rules) -----------------------
RAW_CONTENT_LIMIT = 500          # raw_content is truncated to 500 characters
QUERY_LOG_LIMIT = 50             # logged query preview length
REQUIRED_FIELDS = ("url", "title", "snippet")
RESULT_COUNT_MIN, RESULT_COUNT_MAX = 20, 50
# -----------------------------------------------------------------------------


def normalise_results(raw: DataFrame, keep_crawled_at: bool = True) -> DataFrame:
    """Raw result rows -> normalised result rows.

    ``content`` becomes ``snippet``; a missing field becomes ``''`` (score
    0.0); ``domain`` is the URL's netloc; ``raw_content`` (when present) is
    truncated to 500 characters; ``crawled_at`` is the UTC run time.
    Missing keys and explicit nulls are treated alike (both -> default).
    """
    cols = set(raw.columns)

    def s(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in cols else F.lit("")

    out = [c for c in ("query_id", "rank", "page_id", "doc_id") if c in cols]
    sel = [*out,
           s("url").alias("url"), s("title").alias("title"), s("content").alias("snippet"),
           (F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in cols else F.lit(0.0)).alias("score"),
           s("published_date").alias("published_date"),
           extract_domain(s("url")).alias("domain")]
    if "raw_content" in cols:
        sel.append(F.when(F.col("raw_content").isNotNull(),
                          truncate_text("raw_content", RAW_CONTENT_LIMIT)).alias("raw_content"))
    if keep_crawled_at:
        sel.append(F.current_timestamp().alias("crawled_at"))
    return raw.select(*sel)


def attach_images(results: DataFrame, images: DataFrame, key: str = "query_id",
                  params: DataFrame | None = None) -> DataFrame:
    """Keep images with non-empty url and description, build the markdown,
    and attach the ordered list to the first result (rank 1) of each query.

    ``images``: (key, img_pos, url, description).  Other results get null;
    queries without surviving images are left untouched.  With ``params``,
    only requests whose ``include_images`` is true get images.  The per-query
    image list is bounded by the response's image count.
    """
    ok = images.filter((F.coalesce(F.col("url"), F.lit("")) != "")
                       & (F.coalesce(F.col("description"), F.lit("")) != ""))
    if params is not None:
        # the gate: images are processed only for requests that asked for them
        ok = ok.join(params.filter(F.col("include_images") == F.lit(True)).select(key), key, "left_semi")
    lists = (ok.groupBy(key)
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.col("img_pos"), F.col("url"), F.col("description"),
                 F.format_string("![%s](%s)", F.col("description"), F.col("url")).alias("markdown")))).alias("images"))
             .withColumn("rank", F.lit(1).cast("bigint")))
    return results.join(lists, [key, "rank"], "left")


def validate_batches(requests: DataFrame, raw: DataFrame, key: str = "query_id") -> DataFrame:
    """A batch is valid only when non-empty and every row carries the
    url, title and snippet keys.  ``raw`` has boolean ``has_<field>`` columns.

    Returns (key, n_results, valid) for every request, including empty ones.
    """
    has_all = F.col("has_url") & F.col("has_title") & F.col("has_snippet")
    per = raw.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n_results"),
                               F.bool_and(has_all).alias("all_fields"))
    n = F.coalesce(F.col("n_results"), F.lit(0).cast("bigint"))
    valid = (n > 0) & F.coalesce(F.col("all_fields"), F.lit(False))
    return (requests.select(key).join(per, key, "left")
            .select(key, n.alias("n_results"), valid.alias("valid")))


def quarantine(raw: DataFrame) -> DataFrame:
    """Row-level split of N5: status valid/rejected with the first
    problem as reason.  A present-but-null url is rejected here too: in the
    reference it makes the whole query fail (deliberate deviation: only the
    row is quarantined, the rest of the batch is kept)."""
    reason = F.when(~F.col("has_url"), F.lit("missing url")) \
        .when(~F.col("has_title"), F.lit("missing title")) \
        .when(~F.col("has_snippet"), F.lit("missing snippet"))
    if "url" in raw.columns:
        reason = reason.when(F.col("url").isNull(), F.lit("null url"))
    return raw.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("valid")).otherwise(F.lit("rejected")))


def error_rows(requests: DataFrame, errors: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per request: status 'error' with the message, or 'ok'.

    A failing request yields exactly one error row; others are unaffected.
    """
    one = errors.groupBy(key).agg(F.min("error").alias("error"))
    return (requests.select(key).join(one, key, "left")
            .withColumn("status", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error"))))


def result_count_check(results: DataFrame, requests: DataFrame, lo: int = RESULT_COUNT_MIN,
                       hi: int = RESULT_COUNT_MAX, key: str = "query_id") -> DataFrame:
    """Flag requests whose result count falls outside [lo, hi]."""
    per = results.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n_results"))
    n = F.coalesce(F.col("n_results"), F.lit(0).cast("bigint"))
    return (requests.select(key).join(per, key, "left")
            .select(key, n.alias("n_results"), (~n.between(lo, hi)).alias("out_of_range")))


def field_profile(results: DataFrame, key: str = "query_id") -> DataFrame:
    """Per-query field report: count, titles present, content length,
    raw_content nulls and length."""
    return results.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_results"),
        F.count_if(F.coalesce(F.col("title"), F.lit("")) != "").cast("bigint").alias("n_titled"),
        F.round(F.avg(F.length("snippet")), 4).alias("avg_snippet_len"),
        F.count_if(F.col("raw_content").isNull()).cast("bigint").alias("n_raw_null"),
        F.round(F.avg(F.length("raw_content")), 4).alias("avg_raw_len"),
    )


def image_request_check(params: DataFrame, images: DataFrame, key: str = "query_id") -> DataFrame:
    """Requests that asked for images but got none usable, plus image
    rows with an empty url or description.

    Returns (key, issue, n) with issue in {'no_images', 'empty_url', 'empty_description'}.
    """
    asked = params.filter(F.col("include_images") == F.lit(True)).select(key)
    usable = images.filter((F.coalesce(F.col("url"), F.lit("")) != "")
                           & (F.coalesce(F.col("description"), F.lit("")) != "")).select(key)
    missing = (asked.join(usable, key, "left_anti")
               .select(key, F.lit("no_images").alias("issue"), F.lit(1).cast("bigint").alias("n")))
    bad = (images.select(key, F.explode(F.array(
        F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.lit("empty_url")),
        F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.lit("empty_description")))).alias("issue"))
        .filter(F.col("issue").isNotNull())
        .groupBy(key, "issue").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return missing.unionByName(bad)


def rank_within(df: DataFrame, key: str, order_cols) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order_cols)).cast("bigint"))
