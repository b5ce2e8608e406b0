"""Dedup and diversity.

Exact dedup groups by a SHA-256 of the text, so the shuffle carries 32-byte
keys instead of whole documents, and partial aggregation collapses a hot
group (many copies of one text) map-side.  First-occurrence selection uses
``min(struct(pos, ...))``, an aggregate with a map-side partial, instead of
a window that would pull a hot group into one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_citations(annotations: DataFrame, msg: str = "msg_id") -> DataFrame:
    """Distinct by url within a message; first occurrence wins and keeps
    its position; title falls back to the url when null or empty.

    ``annotations``: (msg, pos, title, url).  Returns (msg, pos, title, url).
    """
    first = (annotations.groupBy(msg, "url")
             .agg(F.min(F.struct("pos", "title")).alias("f")))
    return first.select(msg, F.col("f.pos").alias("pos"),
                        F.coalesce(F.nullif(F.col("f.title"), F.lit("")), F.col("url")).alias("title"),
                        "url")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text (the smallest id), with the copy count."""
    h = F.sha2(F.col(text_col), 256)
    kept = (df.select(id_col, h.alias("_h"))
            .groupBy("_h").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).cast("bigint").alias("n_copies")))
    return df.join(kept.drop("_h"), id_col)


def diversify(results: DataFrame, per_domain: int = 2, key: str = "query_id",
              domain: str = "domain", score: str = "score", tie: str = "page_id") -> DataFrame:
    """At most ``per_domain`` results per (query, domain), best first.

    ``row_number() <= literal`` is planned with a partial WindowGroupLimit,
    so a hot domain ships at most ``per_domain`` rows per map task.
    """
    w = Window.partitionBy(key, domain).orderBy(F.col(score).desc(), F.col(tie))
    return (results.withColumn("domain_rank", F.row_number().over(w))
            .filter(F.col("domain_rank") <= per_domain)
            .withColumn("domain_rank", F.col("domain_rank").cast("bigint")))


def source_mix(df: DataFrame, dims=("source", "lang")) -> DataFrame:
    """Counts by each dimension with rollup subtotals, and share of the total.

    ``level`` is the Spark grouping id (0 = finest).
    """
    total = df.select(F.count(F.lit(1)).cast("double")).scalar()
    return (df.rollup(*dims)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.grouping_id().cast("bigint").alias("level"))
            .withColumn("share", F.round(F.col("n") / total, 4)))


def balance(df: DataFrame, dim: str) -> DataFrame:
    """Balance of one dimension = the largest group's share (1.0 = one group only)."""
    total = df.select(F.count(F.lit(1)).cast("double")).scalar()
    return (df.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_groups"),
                 F.round(F.max("n") / total, 4).alias("max_share")))


# --- D3: near duplicates -------------------------------------------------------
NUM_PERM = 64
BANDS, ROWS_PER_BAND = 16, 4
NEAR_DUP_THRESHOLD = 0.8
#: ids that are sent to all tasks rather than texts and shingles shuffled to them
MOST_SENT = 1 << 20


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shingles): distinct lower-cased word 3-grams of the whole text, as 64-bit hashes
    (a text of one or two words is a single shingle)."""
    from tessera.operators import shingles
    return shingles.shingle_sets(df, id_col, text_col)


def prefix_keys(sets: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """(id, key, size): the rarest shingles of each set, as many as two sets need to share
    one if their Jaccard similarity reaches the threshold (size - ceil(threshold * size) + 1 of each,
    in one order of all shingles: number of sets that hold it, then hash).  A set that comes twice
    counts as one."""
    from tessera.functions.text import explode_rows
    own = sets.select(id_col, F.size("shingles").alias("size"), F.xxhash64("shingles").alias("_set"), "shingles")
    rows = explode_rows(own, [id_col, "size", "_set"], F.col("shingles"), "key")
    count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_df"))
    w = Window.partitionBy(id_col, "size", "_set").orderBy("_df", "key")
    # 1e-9: the product of a threshold and a size may lie a rounding error above a whole number
    most = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
    return (rows.join(count, "key").withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") <= most)
            .select(id_col, "key", "size"))


def _among(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` with one of the distinct ``ids`` (a projection of a written table).  So many ids
    as a task holds easily go to the rows; else the rows are shuffled."""
    few = ids.count() <= MOST_SENT
    return df.join(F.broadcast(ids) if few else ids, id_col, "left_semi")


def _verified(sets: DataFrame, pairs: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """(id, rep, jaccard) of the pairs whose exact shingle Jaccard reaches the threshold."""
    a = sets.withColumnRenamed("shingles", "_a")
    reps = pairs.select(F.col("rep").alias(id_col)).distinct()
    b = _among(sets, reps, id_col).select(F.col(id_col).alias("rep"), F.col("shingles").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(a, id_col).join(b, "rep")
            .select(id_col, "rep", (common / (F.size("_a") + F.size("_b") - common)).alias("jaccard"))
            .filter(F.col("jaccard") >= threshold))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = NEAR_DUP_THRESHOLD) -> DataFrame:
    """D3: documents that are near copies of an earlier one.  Returns
    (id, dup_of, jaccard), ``dup_of`` the smallest earlier id that shares an
    LSH band and reaches the threshold by exact shingle Jaccard.

    * Copies (equal normalized texts) form one class; its smallest id stands
      for it, so a group of copies is never compared within itself.
    * Each member of a band bucket is compared with the bucket's smallest id.
      A match there is the smallest this bucket can give: the member is done
      in it.  This settles nearly all members of a large group of near
      copies at a cost linear in the group.
    * Members that do not match it are compared with other earlier members of
      such buckets, as far as these are earlier than a match they have
      already.  For this they meet by a second key, the rarest of their
      shingles (:func:`prefix_keys`): unlike members, whose rare shingles
      differ, do not meet, so a bucket costs no product of its members.  Pairs
      that share too few of them to reach the threshold are not verified.
      Pairs whose signatures agree in less than half of the minima are not
      verified (at Jaccard 0.8 that befalls less than one pair in a million).

    Proposals are probabilistic (a pair of Jaccard 0.8 shares a band with
    probability 0.9998); verified pairs are exact (shingles as 64-bit hashes).
    Texts are read once for signatures, and those of the documents that share a
    band once more for their shingles; both are written tables, as are matches.
    Documents without a word have no row.
    """
    from tessera.session import materialize
    from tessera.operators.shingles import signatures
    facts = materialize(signatures(df, id_col, text_col, NUM_PERM), "near-dup-signatures")
    classes = facts.groupBy("words").agg(F.min(id_col).alias("_first"))
    copies = materialize(facts.select(id_col, "words").join(classes, "words").select(id_col, "_first"), "near-dup-copies")
    firsts = copies.filter(F.col(id_col) == F.col("_first")).select(id_col).distinct()
    sig = materialize(facts.join(firsts, id_col, "left_semi").select(id_col, "size", "sig"), "near-dup-firsts")
    band_keys = F.array(*[F.xxhash64(F.slice(F.col("sig"), b * ROWS_PER_BAND + 1, ROWS_PER_BAND), F.lit(b))
                          for b in range(BANDS)])
    bands = sig.select(id_col, F.posexplode(band_keys).alias("band", "bkey"))
    reps = bands.groupBy("band", "bkey").agg(F.min(id_col).alias("rep"), F.max(id_col).alias("_last")).filter("rep < _last")
    with_rep = bands.join(reps.drop("_last"), ["band", "bkey"]).filter(F.col("rep") < F.col(id_col))
    with_rep = materialize(with_rep.select(id_col, "band", "bkey", "rep"), "near-dup-buckets")
    proposed = materialize(with_rep.select(id_col, "rep").distinct(), "near-dup-candidates")
    crowd = proposed.select(id_col).union(proposed.select("rep")).distinct()
    sets = materialize(shingle_sets(_among(df, crowd, id_col), id_col, text_col), "near-dup-shingles")
    hits = materialize(_verified(sets, proposed, id_col, threshold), "near-dup-matches")

    found = hits
    best = hits.groupBy(id_col).agg(F.min("rep").alias("_best"))
    rest = with_rep.join(hits.select(id_col, "rep"), [id_col, "rep"], "left_anti").select(id_col, "band", "bkey", "rep")
    rest = materialize(rest, "near-dup-rest")
    if not rest.isEmpty():
        crowd = with_rep.join(rest.select("band", "bkey").distinct(), ["band", "bkey"], "left_semi").select(id_col)
        crowd = crowd.union(rest.select("rep")).distinct()
        keys = materialize(prefix_keys(sets.join(crowd, id_col, "left_semi"), id_col, threshold), "near-dup-prefixes")
        mine = keys.join(rest.select(id_col).distinct(), id_col, "left_semi").join(best, id_col, "left")
        other = keys.select("key", F.col(id_col).alias("_other"), F.col("size").alias("_size"))
        earlier = F.col("_other") < F.coalesce(F.col("_best"), F.col(id_col))
        near = (F.col("_size") >= threshold * F.col("size")) & (F.col("size") >= threshold * F.col("_size"))
        # what two sets have in common lies in both prefixes, or beyond the one that ends first
        beyond = F.ceil(F.lit(threshold) * F.greatest("size", "_size") - 1e-9) - 1
        enough = F.col("_n") + beyond >= F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("_size")) - 1e-9
        more = (mine.join(other, "key").filter(earlier & near).groupBy(id_col, "_other", "size", "_size").agg(F.count("*").alias("_n"))
                .filter(enough).select(id_col, F.col("_other").alias("rep")).distinct())
        mine, other = (sig.select(F.col(id_col).alias(i), F.col("sig").alias(c)) for i, c in ((id_col, "_a"), ("rep", "_b")))
        agreeing = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
        more = more.join(mine, id_col).join(other, "rep").filter(agreeing >= NUM_PERM // 2).select(id_col, "rep").distinct()
        more = materialize(more.join(proposed, [id_col, "rep"], "left_anti"), "near-dup-candidates")
        found = hits.unionByName(_verified(sets, more, id_col, threshold))
    m = found.groupBy(F.col(id_col).alias("_first")).agg(F.min(F.struct("rep", "jaccard")).alias("m"))
    copy = F.when(F.col(id_col) != F.col("_first"), F.col("_first"))
    return (copies.join(m, "_first", "left")
            .select(id_col, F.coalesce(F.col("m.rep"), copy).alias("dup_of"),
                    F.round(F.coalesce(F.col("m.jaccard"), F.lit(1.0)), 4).alias("jaccard"))
            .filter(F.col("dup_of").isNotNull()))
