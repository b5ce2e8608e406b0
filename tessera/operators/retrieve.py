"""Retrieval (R1-R8), re-aimed from the hosted search call to a corpus table.

Scale notes
-----------
* BM25 (R1) never shuffles the full token stream: document length comes
  from ``size(tokens)`` in-row, and only tokens that occur in some query
  survive the semi join against the query vocabulary before the
  ``(doc_id, term)`` aggregation.  Corpus statistics (N, avgdl) are a
  one-row scalar subquery, evaluated once.
* Joins carry no broadcast hints on data-derived sides, but for the terms
  of one block of requests (bounded) in :func:`search`; AQE converts a
  sort-merge join to a broadcast join at run time when the measured side
  is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits
  skewed partitions (a hot term) otherwise.
* Top-k (R6) is ``row_number() <= k AND row_number() <= 50``: the literal
  bound lets Catalyst insert a partial ``WindowGroupLimit`` before the
  shuffle, so a hot query key ships at most 50 rows per map task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import explode_rows, tokenize
from tessera.operators import postings as ps

# --- fixed values ------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
RESULT_CAP = 50                      # max_results never exceeds 50
SCORE_DIGITS = 4                     # scores are rounded before ranking
# Range name -> interval kept by time_range_filter.
RANGE_INTERVAL = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}
# Source-tier weights used by coverage and rerank: tier 1, 2, 3, untiered.
TIER_WEIGHT = {1: 1.0, 2: 0.8, 3: 0.6, None: 0.2}
RECENCY_HALF_LIFE_DAYS = 365.0
# -----------------------------------------------------------------------------


def query_terms(requests: DataFrame, query_col: str = "query") -> DataFrame:
    """(query_id, term): distinct tokens of each query."""
    return explode_rows(requests, ["query_id"], F.array_distinct(tokenize(query_col)), "term")


def build_index(corpus: DataFrame, vocab: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Inverted index in one tokenization pass: (_id, dl, term, tf).

    One row per (document, term) -- restricted to ``vocab`` when given --
    plus one row per document with ``term`` null that carries its length,
    so corpus statistics come from the same pass.  A document's tokens are
    counted in its own row, so a task holds one batch of documents, however
    many it reads, and drops the terms outside a vocabulary of up to
    HELD_TERMS.  One row per document is shuffled, with its counts and not
    its tokens, only to add up those of rows that have the same id and
    length.
    """
    docs = corpus.select(F.col(id_col).alias("_id"), tokenize(text_col).alias("tokens"))
    docs = docs.select("_id", F.size("tokens").cast("double").alias("dl"), "tokens")
    id_type = docs.schema["_id"].dataType.simpleString()
    held = None
    if vocab is not None:
        held = [r.term for r in vocab.select("term").limit(ps.HELD_TERMS + 1).collect()]
        held = held if len(held) <= ps.HELD_TERMS else None
    counts = docs.mapInArrow(ps.token_counts(held), f"_id {id_type}, dl double, terms array<string>, tfs array<double>")
    rows = (counts.repartition("_id").sortWithinPartitions("_id", "dl")
            .mapInArrow(ps.added_up, f"_id {id_type}, dl double, term string, tf double"))
    if vocab is not None and held is None:
        # the null term stands for the rows of the lengths
        known = vocab.select("term").unionByName(vocab.sparkSession.createDataFrame([(None,)], "term string"))
        rows = rows.alias("r").join(known.alias("k"), F.col("r.term").eqNullSafe(F.col("k.term")), "left_semi")
    return rows


def score_index(index: DataFrame, qterms: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 from an index of :func:`build_index`: (query_id, _id, score)."""
    scored = bm25_weights(index, k1, b).select("_id", "term", F.col("w").alias("c"))
    return (qterms.join(scored, "term")
            .groupBy("query_id", "_id")
            .agg(F.round(F.sum("c"), SCORE_DIGITS).alias("score")))


def keyword_search(corpus: DataFrame, requests: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", query_col: str = "query",
                   k1: float = BM25_K1, b: float = BM25_B, materialize: bool = True,
                   index: DataFrame | None = None) -> DataFrame:
    """BM25 relevance of every matching document for every request.

    Returns (query_id, <id_col>, score) with score rounded to 4 places; rows
    exist only for documents sharing at least one term with the query.
    Uncapped: combine with :func:`top_k_per_query`.

    The index (postings of query terms + document lengths) is read three
    times (N/avgdl, df, tf); with ``materialize`` it is written once to the
    shared checkpoint folder so the text is tokenized exactly once.
    """
    qterms = query_terms(requests, query_col)
    if index is None:
        # an index built for a superset of these terms may be passed in:
        # df, N and avgdl do not depend on the vocabulary restriction
        index = build_index(corpus, qterms.select("term").distinct(), id_col, text_col)
        if materialize:
            from tessera.session import materialize as _mat
            index = _mat(index, "bm25-index")
    return score_index(index, qterms, k1, b).withColumnRenamed("_id", id_col)


def match_counts(corpus: DataFrame, requests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 query_col: str = "query", index: DataFrame | None = None) -> DataFrame:
    """(query_id, n_matches): documents sharing any term with each query (uncapped), from a BM25
    index whose vocabulary holds the queries' terms (built where none is given)."""
    from tessera.session import materialize
    if index is None:
        vocab = query_terms(requests, query_col).select("term").distinct()
        index = materialize(build_index(corpus, vocab, id_col, text_col), "bm25-index")
    n_docs = index.filter(F.col("term").isNull()).count()
    postings = index.filter(F.col("term").isNotNull()).select("term", "_id", F.col("tf").alias("w"))
    return ps.matching(postings, n_docs, ps.request_terms(requests, tokenize(query_col)))


def top_k_per_query(df: DataFrame, k: Column | int | None = None, key: str = "query_id",
                    score: str = "score", tie: str = "doc_id", cap: int | None = RESULT_CAP) -> DataFrame:
    """Rank <= k (a column or literal) and rank <= ``cap``, ties broken by id.

    The cap is that of one search call; ``cap=None`` ranks without it (merged
    and reranked results).  Adds ``rank`` (bigint, 1-based).
    """
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    ranked = df.withColumn("rank", F.row_number().over(w))
    cond = F.lit(True) if cap is None else F.col("rank") <= F.lit(cap)
    if k is not None:
        kc = k if isinstance(k, Column) else F.lit(k)
        cond = cond & (F.col("rank") <= kc)
    return ranked.filter(cond).withColumn("rank", F.col("rank").cast("bigint"))


def search(corpus: DataFrame, params: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           index: DataFrame | None = None) -> DataFrame:
    """R1 + R6: BM25 results capped by each request's ``max_results`` and by 50, ranked inside the tasks
    that hold the documents (:mod:`tessera.operators.postings`)."""
    from tessera.session import materialize
    if index is None:
        vocab = query_terms(params).select("term").distinct()
        index = materialize(build_index(corpus, vocab, id_col, text_col), "bm25-index")
    n_docs = index.filter(F.col("term").isNull()).count()
    asked = ps.request_terms(params, tokenize("query"), F.when(F.col("max_results") < RESULT_CAP, F.col("max_results"))
                             .when(F.col("max_results").isNotNull(), RESULT_CAP))
    hits = ps.top_k(lambda terms: bm25_weights(index, terms=terms), n_docs, asked, index.schema["_id"].dataType.simpleString())
    return hits.select("query_id", F.col("_id").alias(id_col), "score", "rank")


def phrase_filter(results: DataFrame, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """R2: every double-quoted phrase of the query must occur in the text (case-insensitive)."""
    phrases = F.regexp_extract_all(F.col(query_col), F.lit(r'"([^"]+)"'), 1)
    txt = F.lower(F.col(text_col))
    return results.filter(F.forall(phrases, lambda p: F.instr(txt, F.lower(p)) > 0))


def time_range_filter(df: DataFrame, ts_col: str, range_col: str, as_of) -> DataFrame:
    """Keep rows newer than ``as_of - range``; a null range keeps all rows.

    Rows without a timestamp are dropped when a range is set.  ``as_of`` is a
    literal or a column; the bound is compared in the column's own type.
    """
    asof = as_of if isinstance(as_of, Column) else F.lit(as_of)
    asof = asof.cast(df.schema[ts_col].dataType)
    rng = F.col(range_col)
    cond = rng.isNull()
    for name, iv in RANGE_INTERVAL.items():
        cond = cond | ((rng == name) & (F.col(ts_col) > asof - F.expr(f"INTERVAL {iv}")))
    return df.filter(cond)


def topic_filter(df: DataFrame, topic_col: str, wanted_col: str) -> DataFrame:
    """R4: "general" (or null) keeps everything, otherwise topic equality."""
    wanted = F.col(wanted_col)
    return df.filter(wanted.isNull() | (wanted == "general") | (F.col(topic_col) == wanted))


def merge_searches(*results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Union of several searches; best score per (query_id, id), re-ranked.

    Each search is cut by its own ``max_results`` before; the merged list is
    not cut and may hold more rows than one search.  Partial aggregation collapses duplicates map-side before the shuffle.
    """
    u = results[0]
    for r in results[1:]:
        u = u.unionByName(r, allowMissingColumns=True)
    best = u.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    return top_k_per_query(best, None, tie=id_col, cap=None)


def tier_weight(tier: Column) -> Column:
    w = F.lit(TIER_WEIGHT[None])
    for t in (3, 2, 1):
        w = F.when(tier == t, F.lit(TIER_WEIGHT[t])).otherwise(w)
    return w


def rerank(results: DataFrame, as_of=None, date_col: str | None = None,
           id_col: str = "doc_id") -> DataFrame:
    """Score x tier weight x recency decay (undated rows neutral), re-ranked; no row is cut.

    Expects a ``tier`` column (see ``credibility.tier_sources``).
    """
    decay = F.lit(1.0)
    if date_col is not None and as_of is not None:
        age = F.datediff(F.lit(as_of).cast("date"), F.col(date_col).cast("date"))
        decay = F.coalesce(F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / F.lit(RECENCY_HALF_LIFE_DAYS)), F.lit(1.0))
    adj = F.round(F.col("score") * tier_weight(F.col("tier")) * decay, SCORE_DIGITS)
    return top_k_per_query(results.withColumn("rerank_score", adj).drop("rank"), None,
                           score="rerank_score", tie=id_col, cap=None)


# --- exact top-k with pruning (MaxScore-style) ---------------------------------
HOT_DF_FRACTION = 0.05      # a term in more than 5% of documents is "hot"
PRUNE_MARGIN = 1e-4         # safety margin for float sums and 4-place rounding


def bm25_weights(index: DataFrame, k1: float = BM25_K1, b: float = BM25_B, terms: DataFrame | None = None) -> DataFrame:
    """Query-independent BM25 weight of every posting of an index from
    :func:`build_index`: (term, _id, w, df).  ``terms``: a bounded set of terms
    (term) to keep; the postings then are not shuffled by their terms."""
    lens = index.filter(F.col("term").isNull())
    post = index.filter(F.col("term").isNotNull())
    stats = lens.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"),
                              F.avg("dl").alias("avgdl")).alias("s")).scalar()
    if terms is not None:
        post = post.join(F.broadcast(terms), "term", "left_semi")
    dfreq = post.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    if terms is not None:
        dfreq = F.broadcast(dfreq)
    idf = F.ln(F.lit(1.0) + (stats["n"] - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    w = (idf * (F.col("tf") * F.lit(k1 + 1.0))
         / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / stats["avgdl"])))
    return post.join(dfreq, "term").select("term", "_id", w.alias("w"), "df")


def search_topk(corpus: DataFrame, params: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                query_col: str = "query", hot_df_fraction: float = HOT_DF_FRACTION) -> DataFrame:
    """R1 + R6 with MaxScore pruning: the same result as :func:`search`.

    Phase 1: documents holding a non-hot query term are scored in full;
    theta0, the k-th best of those real scores, is a lower bound of the
    final k-th score.  Phase 2: the query's lowest-impact terms whose summed
    maximum weights stay below theta0 (minus a margin) are non-essential --
    a document holding only those cannot reach the top k -- so only
    documents holding an essential term are scored.  Exact for every
    request (theta0 = 0 when phase 1 has fewer than k candidates, which makes
    every term essential).
    """
    from tessera.session import materialize
    qterms = query_terms(params, query_col)
    index = materialize(build_index(corpus, qterms.select("term").distinct(), id_col, text_col), "bm25-index")
    n_docs = index.filter(F.col("term").isNull()).select(F.count(F.lit(1)).cast("double")).scalar()
    weights = materialize(bm25_weights(index), "bm25-weights")
    tstats = weights.groupBy("term").agg(F.max("w").alias("maxw"), F.max("df").alias("df"))
    qt = (qterms.join(tstats, "term")
          .withColumn("hot", F.col("df") > F.greatest(F.lit(1.0), n_docs * F.lit(hot_df_fraction))))
    k = params.select("query_id", F.least(F.col("max_results"), F.lit(RESULT_CAP)).alias("k"))
    post = weights.select("term", "_id", "w")

    def scored_topk(terms: DataFrame) -> DataFrame:
        """Top-k over documents holding any of ``terms`` (query_id, term),
        each scored over all of the query's terms."""
        pairs = terms.join(post.select("term", "_id"), "term").select("query_id", "_id").distinct()
        qd = pairs.join(qt.select("query_id", "term"), "query_id")
        sc = (qd.join(post, ["term", "_id"]).groupBy("query_id", "_id")
              .agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))
        return top_k_per_query(sc.join(k, "query_id"), F.col("k"), tie="_id")

    phase1 = scored_topk(qt.filter(~F.col("hot")).select("query_id", "term"))
    theta0 = (k.join(phase1.filter(F.col("rank") == F.col("k")).select("query_id", F.col("score").alias("t")),
                     "query_id", "left")
              .select("query_id", F.coalesce(F.col("t"), F.lit(0.0)).alias("theta0")))
    # cumulative max weight of the query's terms, lowest impact first (one
    # small window per request over its own terms)
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("maxw").asc(), F.col("term").asc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    ess = (qt.join(theta0, "query_id").withColumn("cum", F.sum("maxw").over(w))
           .filter(F.col("cum") + F.lit(PRUNE_MARGIN) >= F.col("theta0") - F.lit(PRUNE_MARGIN))
           .select("query_id", "term"))
    return scored_topk(ess).drop("k").withColumnRenamed("_id", id_col)
