"""Registered queries: SQL surface (U1, U2), batch generation (U3), report
sink (S4), vectors (M2, R5) and the visual inventory (M9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.sql import register_scalar_functions, register_search_function
from tessera.operators import normalise as nz
from tessera.operators import summarise as sm
from tessera.operators import vector_index as vi
from tessera.operators import vectors as vc
from tessera.operators.generate import batch_generate
from tessera.operators.routed import routed_search
from tessera.operators.themes import theme_terms
from tessera.plans import derived as dv
from tessera.plans import sqlparts as sp
from tessera.plans.catalog import register
from tessera.sources.report_files import read_report_run, write_report_run
from tessera.sources.sinks import read_reports, write_reports
from tessera.sources.tables import load


@register("sql_search", sp.sql(sp.doc_search(), "SELECT query_id, rank, doc_id, score FROM doc_search"))
def q_sql_search(spark, d):
    """The SQL table function ``search(q, k)`` in a LATERAL join over the
    requests; equals R1 + R6."""
    register_search_function(spark, load(spark, d, "documents"), index=dv.doc_index(spark, d))
    dv.params(spark, d).createOrReplaceTempView("tessera_requests")
    return spark.sql("""SELECT r.query_id, CAST(s.rank AS BIGINT) AS rank, s.doc_id, s.score
      FROM tessera_requests r, LATERAL search(r.query, CAST(r.max_results AS INT)) s""")


@register("sql_functions", f"""SELECT page_id, {sp.domain('url')} AS domain, {sp.truncate('url', 20)} AS url_20
FROM pages""")
def q_sql_functions(spark, d):
    """extract_domain / truncate_text called from SQL."""
    register_scalar_functions(spark)
    load(spark, d, "pages").createOrReplaceTempView("tessera_pages")
    return spark.sql("SELECT page_id, extract_domain(url) AS domain, truncate_text(url, 20) AS url_20 "
                     "FROM tessera_pages")


def length_stub(prompt: str, attempt: int) -> str:
    """A pure stand-in for a model call: fails on secret-like prompts, fails
    once (transiently) when the length is a multiple of 10."""
    if "token" in prompt:
        raise ValueError("secret-like prompt")
    if attempt == 1 and len(prompt) % 10 == 0:
        raise TimeoutError("transient")
    return str(len(prompt))


@register("batch_generate", """SELECT doc_id,
  CASE WHEN strpos(text, 'token') > 0 THEN NULL ELSE CAST(length(text) AS VARCHAR) END AS output,
  CASE WHEN strpos(text, 'token') > 0 THEN 'ValueError: secret-like prompt' END AS error,
  CAST(CASE WHEN strpos(text, 'token') > 0 THEN 3 WHEN length(text) % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts
FROM documents""")
def q_batch_generate(spark, d):
    """A user function over every document with per-row retries and a ledger of what is done; the
    stub needs no waits."""
    from tessera.streaming.runner import _path
    return batch_generate(load(spark, d, "documents"), "doc_id", "text", length_stub, waits=(), ledger=_path(spark, "ledger", "u3"))


@register("write_reports", sp.sql(sp.reports(), "SELECT report_id, body FROM reports"))
def q_write_reports(spark, d):
    """Reports written one file per report and read back."""
    from tessera.streaming.runner import _path
    path = _path(spark, "reports", "s4")
    write_reports(dv.reports(spark, d), path, run_ts="20240131_000000")
    return read_reports(spark, path).select("report_id", "body")


@register("theme_clusters", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e)
  GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, e.label, c.label AS theme,
  list_dot_product(e.v, c.cv) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.cv, c.cv))) AS sim
  FROM e CROSS JOIN c)
SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(arg_max(theme, struct_pack(s := sim, neg := -theme)) AS BIGINT) AS theme,
  round(max(sim), 4) AS similarity FROM s GROUP BY vec_id, label""")
def q_theme_clusters(spark, d):
    """M2: nearest label centroid per vector."""
    out = vc.theme_clusters(load(spark, d, "embeddings"))
    return out.select("vec_id", F.col("label").cast("bigint").alias("label"),
                      F.col("theme").cast("bigint").alias("theme"), "similarity")


@register("kmeans_themes")
def q_kmeans_themes(spark, d):
    """M2: learned themes (pyspark.ml KMeans, k = 10); rows-only check."""
    return vc.kmeans_themes(load(spark, d, "embeddings"), k=10)


_THEMES = {"k": 8, "seed": 7, "iterations": 5}
_THEMES_SQL = sp.crc_table() + sp.tfidf("docs_w", "documents", "doc_id", "text", 512) + sp.kmeans("themes", "docs_w", "doc_id", **_THEMES)


@register("write_report_run", sp.sql(sp.reports(), "SELECT report_id, body FROM reports"))
def q_write_report_run(spark, d):
    """Reports as files of one run, committed by a manifest and read back by it."""
    from tessera.streaming.runner import _path
    path = write_report_run(dv.reports(spark, d), _path(spark, "report-run", "s4"), run="20240131_000000")
    return read_report_run(spark, path, "20240131_000000").select(F.col("report_id").cast("bigint").alias("report_id"), "body")


@register("text_themes", sp.sql(_THEMES_SQL, """SELECT d.doc_id, t.theme, round(t.similarity, 4) AS similarity
FROM documents d LEFT JOIN themes t ON d.doc_id = t.doc_id"""))
def q_text_themes(spark, d):
    """M2, learned: documents grouped by k-means over their words."""
    return dv.doc_themes(spark, d, **_THEMES)


@register("theme_terms", sp.sql(_THEMES_SQL + [
    f"theme_tok AS (SELECT DISTINCT doc_id, unnest({sp.tokens('text')}) AS term FROM documents)",
    "theme_per AS (SELECT t.theme, k.term, count(*) AS docs FROM theme_tok k JOIN themes t ON k.doc_id = t.doc_id GROUP BY ALL)"],
    """SELECT theme, rank, term, docs FROM (SELECT theme, term, docs, CAST(row_number() OVER (PARTITION BY theme
  ORDER BY docs * docs / all_docs DESC, term) AS BIGINT) AS rank
  FROM (SELECT *, sum(docs) OVER (PARTITION BY term) AS all_docs FROM theme_per)) WHERE rank <= 5"""))
def q_theme_terms(spark, d):
    """M2: the five terms that mark each learned theme."""
    return theme_terms(load(spark, d, "documents"), dv.doc_themes(spark, d, **_THEMES), "doc_id", "text")


_SEMANTIC_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e)
  GROUP BY label, i) GROUP BY label)
SELECT query_id, vec_id, score, rank FROM (
  SELECT CAST(c.label AS BIGINT) AS query_id, e.vec_id, round(list_dot_product(e.v, c.cv) /
    (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.cv, c.cv))), 4) AS score,
    CAST(row_number() OVER (PARTITION BY c.label ORDER BY round(list_dot_product(e.v, c.cv) /
    (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.cv, c.cv))), 4) DESC, e.vec_id) AS BIGINT) AS rank
  FROM e CROSS JOIN c) WHERE rank <= 5"""


@register("semantic_search", _SEMANTIC_SQL)
def q_semantic_search(spark, d):
    """Top-5 vectors by cosine for each query vector (the label centroids)."""
    emb = load(spark, d, "embeddings")
    queries = vc.centroids(emb).select(F.col("label").alias("query_id"), F.col("centroid").alias("query_vec"))
    return vc.semantic_search(emb, queries, k=5).select(F.col("query_id").cast("bigint").alias("query_id"),
                                                        "vec_id", "score", "rank")


@register("semantic_search_indexed", _SEMANTIC_SQL)
def q_semantic_search_indexed(spark, d):
    """The same rows from the inverted-file index, cells ruled out by their bounds."""
    emb = load(spark, d, "embeddings")
    queries = vc.centroids(emb).select(F.col("label").cast("bigint").alias("query_id"), F.col("centroid").alias("query_vec"))
    return vi.search(vi.build_index(emb), queries, k=5, exact=True)


@register("routed_search", sp.sql(
    sp.params() + ["basic AS (SELECT * FROM params WHERE search_depth <> 'advanced')",
                   "deep AS (SELECT * FROM params WHERE search_depth = 'advanced')"]
    + sp.bm25("route_bm25", "documents", "doc_id", "text", reqs="basic") + sp.topk("route_basic", "route_bm25", "doc_id", reqs="basic")
    + sp.crc_table() + sp.tfidf("docs_w", "documents", "doc_id", "text", 512)
    + sp.tfidf("deep_w", "deep", "query_id", "query", 512, like="docs_w")
    + ["""route_cos AS (SELECT q.query_id, d.doc_id, round(sum(q.w * d.w), 4) AS score
  FROM deep_w q JOIN docs_w d ON q.dim = d.dim GROUP BY ALL)"""] + sp.topk("route_deep", "route_cos", "doc_id", reqs="deep"),
    """SELECT query_id, 'basic' AS search_depth, doc_id, score, rank FROM route_basic
UNION ALL SELECT query_id, 'advanced', doc_id, score, rank FROM route_deep"""))
def q_routed_search(spark, d):
    """R1 and R5 routed by search_depth: basic requests by BM25, advanced ones by word vectors over
    the inverted-file index (all neighbours, so that rows can be compared)."""
    index, model = dv.doc_vectors(spark, d)
    return routed_search(load(spark, d, "documents"), dv.params(spark, d), postings=dv.doc_index(spark, d), index=index, model=model, exact=True)


@register("visual_inventory", sp.sql(sp.web_results() + sp.web_images(), """SELECT w.query_id, w.rank, w.url AS source_url,
  CAST(row_number() OVER (PARTITION BY i.query_id ORDER BY i.img_pos) AS BIGINT) AS img_no,
  i.url AS image_url, i.description
FROM web_results w JOIN web_images i ON i.query_id = w.query_id
WHERE w.rank = 1 AND coalesce(i.url, '') <> '' AND coalesce(i.description, '') <> ''
  AND i.query_id IN (SELECT query_id FROM params WHERE include_images)"""))
def q_visual_inventory(spark, d):
    """M9: every attached image with its request and source result."""
    asked = dv.params(spark, d).filter(F.col("include_images") == F.lit(True)).select("query_id")
    imgs = dv.web_images(spark, d).join(asked, "query_id", "left_semi")
    res = nz.attach_images(dv.web_results(spark, d).select("query_id", "rank", "url"), imgs)
    return sm.visual_inventory(res)
