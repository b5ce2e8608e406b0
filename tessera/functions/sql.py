"""SQL surface (U1, U2): the operators callable from ``spark.sql``.

* U2 ``extract_domain(url)`` and ``truncate_text(text, n)`` are SQL UDFs
  (``CREATE TEMPORARY FUNCTION ... RETURN <expr>``): Catalyst inlines their
  bodies, so they run as ordinary codegen'd expressions.
* U1 ``search(q, k)`` is a SQL table function over a BM25 index view
  (per-posting weights are query-independent and precomputed once), usable
  in ``FROM search('...', 5)`` and in ``LATERAL`` joins; ``k`` is enforced
  with ``row_number`` because a table function cannot take a non-constant
  LIMIT.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ELLIPSIS, NETLOC_PATTERN, TOKEN_PATTERN
from tessera.operators.retrieve import RESULT_CAP, SCORE_DIGITS, bm25_weights, build_index

#: documents of a range of the search view
SEARCH_RANGE = 1024


def _raw(s: str) -> str:
    assert "'" not in s
    return "r'" + s + "'"


def register_scalar_functions(spark: SparkSession) -> None:
    """extract_domain / truncate_text as SQL functions."""
    net = f"regexp_extract(url, {_raw(NETLOC_PATTERN)}, 1)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION extract_domain(url STRING) RETURNS STRING
      RETURN CASE WHEN url IS NULL THEN ''
                  WHEN (instr({net}, '[') > 0) <> (instr({net}, ']') > 0) THEN ''
                  ELSE {net} END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION truncate_text(t STRING, n INT) RETURNS STRING
      RETURN CASE WHEN n < 4 THEN raise_error('truncate_text needs n >= 4')
                  WHEN t IS NULL THEN '' WHEN char_length(t) <= n THEN t
                  ELSE concat(substring(t, 1, n - 3), '{ELLIPSIS}') END""")


def register_search_function(spark: SparkSession, corpus: DataFrame, view: str = "tessera_search_index",
                             index: DataFrame | None = None) -> None:
    """``search(q, k)`` returning (doc_id, score, rank) for query text q.

    ``index``: a written index of :func:`retrieve.build_index` over the corpus, which then is not read
    again; terms beyond its vocabulary find nothing.  The weights are a view over it, dealt by ranges
    of documents: scores are added up and the best of a range are picked where its postings are, so
    what is shuffled for a query is RESULT_CAP rows for each range, not a row for each document."""
    from tessera.session import materialize
    if index is None:
        index = materialize(build_index(corpus, None), "search-index")
    n = max(1, -(-index.where("term is null").count() // SEARCH_RANGE))
    weights = bm25_weights(index).select("term", F.col("_id").alias("doc_id"), "w", F.pmod(F.xxhash64("_id"), F.lit(n)).alias("part"))
    weights.repartition(n, "part").createOrReplaceTempView(view)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search(q STRING, k INT)
      RETURNS TABLE (doc_id BIGINT, score DOUBLE, rank INT)
      RETURN SELECT doc_id, score, rank FROM (
        SELECT d AS doc_id, -s AS score, row_number() OVER (ORDER BY s, d) AS rank FROM (
          SELECT inline(best) FROM (
            SELECT slice(sort_array(collect_list(struct(-score AS s, doc_id AS d))), 1, {RESULT_CAP}) AS best FROM (
              SELECT i.part, i.doc_id, round(sum(i.w), {SCORE_DIGITS}) AS score
              FROM (SELECT explode(array_distinct(regexp_extract_all(lower(q), {_raw(TOKEN_PATTERN)}, 0))) AS term) t
              JOIN {view} i ON i.term = t.term
              GROUP BY i.part, i.doc_id)
            GROUP BY part)))
      WHERE rank <= k AND rank <= {RESULT_CAP}""")
