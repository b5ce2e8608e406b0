"""Summarisation of large result sets.

Sentence and fact extraction are row-local generators.  Ordered windows
are partitioned by the request (bounded by max_results <= 50 documents) or
by a (group, period) key; the per-period trend works on pre-aggregated
counts, so the window sees one row per period, not the raw events.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_PATTERN, explode_rows

# --- fixed values ------------------------------------------------------------
SUMMARISE_ABOVE = 50          # > 50 results -> summarise first (exactly 50 -> credibility)
SUMMARY_MIN_TOKENS = 800
SUMMARY_MAX_TOKENS = 1200
# A sentence: a run of characters other than terminators and newlines,
# followed by its terminators.
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
# Facts: numbers with inner separators, optional percent sign.
FACT_PATTERN = r"[0-9]+(?:[.,:/-][0-9]+)*%?"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"
# Keyed facts: a word, separators, then a number.
KEYED_FACT_PATTERN = r"(\p{L}+)[ :=]+([0-9]+(?:[.,][0-9]+)*)"
QUOTE_PATTERN = r'"([^"\n]{3,})"'
# Sections of a rendered summary that follow its themes, in order.
EXTRA_SECTIONS = (("trends", "Emerging Trends and Patterns"), ("visual", "Visual Content Summary"),
                  ("gaps", "Data Gaps and Limitations"))
# -----------------------------------------------------------------------------


def size_route(counts: DataFrame, n_col: str = "n_results") -> DataFrame:
    """M1: > 50 results -> 'summarise', else 'credibility'."""
    return counts.withColumn("route", F.when(F.col(n_col) > SUMMARISE_ABOVE, F.lit("summarise"))
                             .otherwise(F.lit("credibility")))


def rank_in_theme(df: DataFrame, theme_cols, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """M3: most significant first within each theme."""
    w = Window.partitionBy(*theme_cols).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("theme_rank", F.row_number().over(w).cast("bigint"))


def sentences(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, sent_pos, sentence, n_tokens): non-empty trimmed sentences, 1-based positions."""
    s = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE_PATTERN), 0)
    return (explode_rows(df, [id_col], s, "sentence", pos="sent_pos")
            .select(id_col, (F.col("sent_pos") + 1).cast("bigint").alias("sent_pos"),
                    F.trim(F.col("sentence")).alias("sentence"))
            .filter(F.col("sentence") != "")
            .withColumn("n_tokens", F.size(F.regexp_extract_all(F.lower(F.col("sentence")),
                                                              F.lit(TOKEN_PATTERN), 0)).cast("bigint")))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def extractive_summary(sents: DataFrame, key: str | list[str], order_cols, budget: int = SUMMARY_MAX_TOKENS) -> DataFrame:
    """M4: sentences in order while the running token count stays within budget; ``key``: a request, or
    a request and a theme."""
    w = Window.partitionBy(*_keys(key)).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (sents.withColumn("running_tokens", F.sum("n_tokens").over(w).cast("bigint"))
            .filter(F.col("running_tokens") <= budget))


def summary_flags(summary: DataFrame, key: str | list[str]) -> DataFrame:
    """M4: summaries shorter than 800 tokens are flagged."""
    return (summary.groupBy(*_keys(key)).agg(F.sum("n_tokens").cast("bigint").alias("summary_tokens"),
                                     F.count(F.lit(1)).cast("bigint").alias("n_sentences"))
            .withColumn("too_short", F.col("summary_tokens") < SUMMARY_MIN_TOKENS))


def fact_kind(f: Column) -> Column:
    return (F.when(f.endswith("%"), F.lit("percent"))
            .when(f.rlike(DATE_PATTERN), F.lit("date")).otherwise(F.lit("number")))


def extract_facts(sents: DataFrame, id_col: str) -> DataFrame:
    """M5: numbers, percentages and dates per sentence."""
    f = F.regexp_extract_all(F.col("sentence"), F.lit(FACT_PATTERN), 0)
    return (explode_rows(sents, [id_col, "sent_pos"], f, "fact", pos="fact_pos")
            .select(id_col, "sent_pos", (F.col("fact_pos") + 1).cast("bigint").alias("fact_pos"), "fact",
                    fact_kind(F.col("fact")).alias("kind")))


def keyed_facts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, key, value): a word followed by a number, e.g. ``version 3``."""
    k = F.regexp_extract_all(F.col(text_col), F.lit(KEYED_FACT_PATTERN), 1)
    v = F.regexp_extract_all(F.col(text_col), F.lit(KEYED_FACT_PATTERN), 2)
    return (explode_rows(df, [id_col], F.arrays_zip(k.alias("key"), v.alias("value")), "x")
            .select(id_col, F.lower(F.col("x.key")).alias("key"), F.col("x.value").alias("value")))


def trend(df: DataFrame, ts: str, group: str, grain: str = "day") -> DataFrame:
    """M6: counts per (group, period) and the change from the previous period."""
    per = (df.groupBy(group, F.date_trunc(grain, F.col(ts)).alias("period"))
           .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    w = Window.partitionBy(group).orderBy("period")
    return (per.withColumn("prev_n", F.lag("n").over(w))
            .withColumn("change", F.col("n") - F.col("prev_n")))


def timeline(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """M7: chronological sequence number per key (skew-safe numbering)."""
    from tessera.operators.sequence import sequence_number
    return sequence_number(df, [key], [ts, tie])


def theme_sources(df: DataFrame, theme: str, source: str) -> DataFrame:
    """M8: sources per theme with their share of the theme's evidence
    (one row per pair, so no unbounded list is collected)."""
    per = df.groupBy(theme, source).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    # theme totals by a second (partial) aggregate joined back, not a window:
    # a theme with millions of sources would otherwise sit in one task
    tot = df.groupBy(theme).agg(F.count(F.lit(1)).alias("_tot"))
    return per.join(tot, theme).select(theme, source, "n", F.round(F.col("n") / F.col("_tot"), 4).alias("share"))


def extract_quotes(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Double-quoted spans (3+ characters, one line) with their source row."""
    qs = F.regexp_extract_all(F.col(text_col), F.lit(QUOTE_PATTERN), 1)
    return (explode_rows(df, [id_col], qs, "quote", pos="quote_pos")
            .withColumn("quote_pos", (F.col("quote_pos") + 1).cast("bigint")))


def render_summary(summary: DataFrame, key: str, order_cols, text: str = "sentence") -> DataFrame:
    """One markdown bullet per selected sentence, in order, under a
    theme heading.  The input is already capped by the token budget (M4),
    so the collected list per key is bounded."""
    s = F.struct(*[F.col(c) for c in order_cols], F.col(text).alias("_t"))
    return (summary.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("_a"))
            .select(key, F.concat(F.lit("## Themes\n"),
                                  F.array_join(F.transform("_a", lambda x: F.concat(F.lit("- "), x["_t"])), "\n"))
                    .alias("summary_md")))


def source_attribution(df: DataFrame, theme: str, url: str = "url", tier: str = "tier",
                       date: str = "published_date") -> DataFrame:
    """M8: one row per (theme, url): times used, reliability tier (the best
    seen; null = untiered) and latest publication date (null when not known)."""
    return (df.groupBy(theme, url).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.min(tier).cast("bigint").alias("tier"),
        F.max(F.nullif(F.col(date), F.lit(""))).alias("published_date")))


def render_themes(summary: DataFrame, key: str, theme: str, order_cols, extra: DataFrame,
                  text: str = "sentence", evidence: str = "evidence") -> DataFrame:
    """The whole summary as markdown: a heading per theme (in order of its
    first sentence) with the findings and their evidence (array of strings)
    as sub-bullets, then the fixed sections.  ``extra``: (key, section, pos,
    line), section one of ``EXTRA_SECTIONS``; a section without a line says
    "none".  Keys without a sentence have no row.  The sentences are capped by
    the token budget (M4) and the lines by what one request has."""
    order = [F.col(c) for c in order_cols]
    finding = F.concat(F.lit("\u2022 "), F.col(text),
                       F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("\n  \u25e6 "), e)), ""))
    themes = (summary.groupBy(key, theme)
              .agg(F.array_sort(F.collect_list(F.struct(*order, finding.alias("_f")))).alias("_a"))
              .select(key, F.struct(F.col("_a")[0].alias("_o"), F.col(theme).alias("_t"),
                                    F.array_join(F.transform("_a", lambda x: x["_f"]), "\n").alias("_b")).alias("_s"))
              .groupBy(key).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
              .select(key, F.array_join(F.transform("_s", lambda x, i: F.concat(
                  F.lit("## Major Theme "), (i + 1).cast("string"), F.lit(": "), x["_t"], F.lit("\n"), x["_b"])), "\n\n")
                  .alias("_md")))
    lines = lambda s: F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("pos", "line"))))
    more = extra.groupBy(key).agg(*[lines(s).alias(f"_x{i}") for i, (s, _) in enumerate(EXTRA_SECTIONS)])
    parts = [F.concat(F.lit(f"\n\n## {title}\n"), F.coalesce(F.nullif(
        F.array_join(F.transform(f"_x{i}", lambda x: F.concat(F.lit("\u2022 "), x["line"])), "\n"), F.lit("")), F.lit("\u2022 none")))
        for i, (_, title) in enumerate(EXTRA_SECTIONS)]
    return themes.join(more, key, "left").select(key, F.concat("_md", *parts).alias("summary_md"))


def visual_inventory(results_with_images: DataFrame, key: str = "query_id") -> DataFrame:
    """M9: one row per attached image with its request and source result."""
    return (results_with_images.filter(F.col("images").isNotNull())
            .select(key, "rank", F.col("url").alias("source_url"), F.posexplode("images").alias("img_no", "img"))
            .select(key, "rank", "source_url", (F.col("img_no") + 1).cast("bigint").alias("img_no"),
                    F.col("img.url").alias("image_url"), F.col("img.description").alias("description")))
