"""Credibility and coverage.

Source tiers: the fixed tier list is compiled into a row-local CASE
expression (no join at all).  A caller-supplied tier table is matched by
exploding each host into its label-boundary suffixes and equi-joining; the
tier table is the only side that may be broadcast, and only when the
caller asserts its size bound (it is a rule table, not data).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieve import tier_weight

# --- fixed values (the reference's reliability tiers) -------------------------
# Tier 1: Reuters, Bloomberg, BBC, Associated Press, The Guardian, NYT, WSJ
# Tier 2: CNN, NPR, ABC News, CBS News, NBC News, The Times
# Tier 3: academic (.edu), government (.gov), PubMed, arXiv
# Host suffixes chosen for those names (ours):
TIERS = (
    ("reuters.com", 1), ("bloomberg.com", 1), ("bbc.com", 1), ("bbc.co.uk", 1),
    ("apnews.com", 1), ("theguardian.com", 1), ("nytimes.com", 1), ("wsj.com", 1),
    ("cnn.com", 2), ("npr.org", 2), ("abcnews.go.com", 2), ("cbsnews.com", 2),
    ("nbcnews.com", 2), ("thetimes.co.uk", 2),
    ("edu", 3), ("gov", 3), ("pubmed.ncbi.nlm.nih.gov", 3), ("arxiv.org", 3),
)
COVERAGE_GATE = 0.75           # needs_verification when coverage < 0.75
DOMAIN_TARGET = 5              # ours: 5 distinct domains = full diversity
UNTIERED_SHARE_LIMIT = 0.5     # ours: credibility concern when > half untiered
MIN_CORROBORATION = 2          # a fact needs 2+ distinct sources
# -----------------------------------------------------------------------------


def host_of(domain: Column) -> Column:
    """Lower-case host with userinfo and port removed."""
    h = F.regexp_replace(F.lower(domain), r"^.*@", "")
    return F.regexp_replace(h, r":[0-9]*$", "")


def _suffix_match(host: Column, suffix: str) -> Column:
    return (host == F.lit(suffix)) | host.endswith(F.lit("." + suffix))


def tier_expr(host: Column, tiers=TIERS) -> Column:
    """Best (lowest) tier whose suffix matches the host on a label boundary."""
    out = F.lit(None).cast("bigint")
    for t in sorted({t for _, t in tiers}, reverse=True):
        hit = None
        for s, tt in tiers:
            if tt == t:
                m = _suffix_match(host, s)
                hit = m if hit is None else (hit | m)
        out = F.when(hit, F.lit(t).cast("bigint")).otherwise(out)
    return out


def tier_sources(df: DataFrame, domain_col: str = "domain", tiers=TIERS) -> DataFrame:
    """Adds ``tier`` (1/2/3, null = untiered) from the fixed list or a
    sequence of (suffix, tier) pairs.  Row-local, no shuffle."""
    return df.withColumn("tier", tier_expr(host_of(F.col(domain_col)), tiers))


def tier_sources_table(df: DataFrame, tiers: DataFrame, row_key: str,
                       domain_col: str = "domain", broadcast_tiers: bool = False) -> DataFrame:
    """C1 with a tier *table* (suffix, tier) of arbitrary content.

    Each host is exploded into its label suffixes (bounded by the label
    count of one host) and equi-joined with the table; the best tier per row
    is a grouped ``min`` with map-side partial aggregation.  The tier table
    is broadcast only when the caller vouches for its size
    (``broadcast_tiers``); otherwise AQE decides from its measured size.
    """
    labels = F.split(host_of(F.col(domain_col)), r"\.")
    n = F.size(labels)
    sufs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    ex = df.select(row_key, F.explode(sufs).alias("suffix"))
    t = F.broadcast(tiers) if broadcast_tiers else tiers
    best = ex.join(t, "suffix").groupBy(row_key).agg(F.min("tier").cast("bigint").alias("tier"))
    return df.join(best, row_key, "left")


def coverage_score(results: DataFrame, key: str = "query_id") -> DataFrame:
    """0.5 * min(1, distinct domains / 5) + 0.5 * mean tier weight
    (weights 1.0 / 0.8 / 0.6 / 0.2 for tier 1 / 2 / 3 / untiered)."""
    return (results.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_results"),
        F.count_distinct("domain").cast("bigint").alias("n_domains"),
        F.avg(tier_weight(F.col("tier"))).alias("_w"),
        F.avg(F.when(F.col("tier").isNull(), 1.0).otherwise(0.0)).alias("_untiered"))
        .select(key, "n_results", "n_domains",
                F.round(F.lit(0.5) * F.least(F.lit(1.0), F.col("n_domains") / F.lit(float(DOMAIN_TARGET)))
                        + F.lit(0.5) * F.col("_w"), 4).alias("coverage"),
                F.round(F.col("_untiered"), 4).alias("untiered_share")))


def needs_verification(coverage: DataFrame) -> DataFrame:
    """Coverage below 0.75 or more than half of the sources untiered."""
    return coverage.withColumn(
        "needs_verification",
        (F.col("coverage") < F.lit(COVERAGE_GATE)) | (F.col("untiered_share") > F.lit(UNTIERED_SHARE_LIMIT)))


def corroboration(facts: DataFrame, fact: str = "fact", source: str = "source",
                  min_sources: int = MIN_CORROBORATION) -> DataFrame:
    """C4: per fact, distinct supporting sources and whether there are >= 2."""
    return (facts.groupBy(fact).agg(F.count_distinct(source).cast("bigint").alias("n_sources"))
            .withColumn("corroborated", F.col("n_sources") >= min_sources))


def find_conflicts(facts: DataFrame, key: str = "key", value: str = "value",
                   source: str = "source") -> DataFrame:
    """Fact rows whose key has different values in different sources.

    A key with two values and two sources always has two facts that differ in
    both; the extremes show either with a partial aggregate of four values."""
    bad = (facts.groupBy(key).agg(F.min(value).alias("_v0"), F.max(value).alias("_v1"),
                                  F.min(source).alias("_s0"), F.max(source).alias("_s1"))
           .filter("_v0 < _v1 and _s0 < _s1").select(key))
    return facts.join(bad, key, "left_semi")


def coverage_gaps(expected: DataFrame, found: DataFrame, keys=("query_id", "term")) -> DataFrame:
    """Expected aspects with no evidence (anti join)."""
    return expected.join(found, list(keys), "left_anti")


def scope_profile(df: DataFrame, ts: str = "ts", dim: str = "event_type", actor: str = "user_id",
                  recent_days: int = 7) -> DataFrame:
    """Temporal span and recency per group, with a grand-total row
    (``dim`` null) from ``rollup``."""
    last = df.select(F.max(ts)).scalar()
    recent = F.col(ts) > (last - F.expr(f"INTERVAL {recent_days} DAYS"))
    return (df.rollup(dim).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_distinct(actor).cast("bigint").alias("n_actors"),
        F.count_distinct(F.to_date(ts)).cast("bigint").alias("n_days"),
        F.round(F.avg(F.when(recent, 1.0).otherwise(0.0)), 4).alias("recent_share"))
        .withColumn("span_days", F.datediff(F.col("last_ts"), F.col("first_ts")).cast("bigint")))


def language_profile(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents, sources and share of the whole per language (null
    languages are one group)."""
    total = df.select(F.count(F.lit(1)).cast("double")).scalar()
    return (df.groupBy(lang).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 F.count_distinct(source).cast("bigint").alias("n_sources"))
            .withColumn("share", F.round(F.col("n") / total, 4)))


#: buckets of a sketch: 2 ** 12, a relative standard error of 1.04 / sqrt(2 ** 12), that is 1.6 %
SKETCH_LG = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG / 2)


def scope_cube(df: DataFrame, dims: list[str], actor: str) -> DataFrame:
    """Rows and distinct actors for every combination of ``dims`` (period, language, region, ...),
    from the finest groups up to the whole.  (dims..., level, n, n_actors); ``level`` has a bit for each
    dimension that is summed over (``grouping_id``), so a null that is data is told from one that is not.

    Rows are aggregated once, into the finest groups with a HyperLogLog sketch of the actors each; the
    cube merges sketches, so what is repeated for its levels are groups and not rows.  ``n`` is exact;
    ``n_actors`` has a relative standard error of SKETCH_ERROR."""
    finest = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"),
                                   F.hll_sketch_agg(F.xxhash64(actor), SKETCH_LG).alias("_actors"))
    cube = finest.cube(*dims).agg(F.grouping_id().cast("bigint").alias("level"), F.sum("_n").cast("bigint").alias("n"),
                                  F.hll_union_agg("_actors").alias("_actors"))
    return cube.select(*dims, "level", "n", F.hll_sketch_estimate("_actors").alias("n_actors"))
