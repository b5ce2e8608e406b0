"""Search routed by ``search_depth``: ``advanced`` requests are answered by the vectors of their words
over an inverted-file index (R5), all others (the depth is passed through unchecked) by BM25 (R1)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import retrieve as rt
from tessera.operators.features import DIMS, TfIdf, text_features, token_dims
from tessera.operators.vector_index import VectorIndex, build_index, search


def text_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS) -> tuple[VectorIndex, TfIdf]:
    """The index of a corpus' hashed TF-IDF vectors, and the frequencies that weigh requests."""
    features, model = text_features(corpus, id_col, text_col, dims)
    return build_index(features, id_col, "features"), model


def advanced_search(requests: DataFrame, index: VectorIndex, model: TfIdf, exact: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) for requests with ``max_results``; a request without words, or
    whose words no document tells apart, finds nothing."""
    words = model.transform(token_dims(requests, "query_id", "query", len(model.idf)), "query_id")
    vectors = words.join(requests.where("max_results is not null")
                         .select("query_id", F.least("max_results", F.lit(rt.RESULT_CAP)).alias("k")), "query_id")
    return search(index, vectors, k="k", qvec="features", exact=exact, probes=probes)


def routed_search(corpus: DataFrame, requests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  postings: DataFrame | None = None, index: VectorIndex | None = None, model: TfIdf | None = None,
                  exact: bool = False) -> DataFrame:
    """(query_id, search_depth, id, score, rank), at most ``max_results`` and 50 rows for each request.

    ``postings`` (a BM25 index), ``index`` and ``model`` are built where they are not handed over.
    ``exact``: advanced requests get their true neighbours, at the price of more cells read."""
    deep = F.coalesce(F.col("search_depth"), F.lit("")) == "advanced"
    basic = rt.search(corpus, requests.where(~deep), id_col=id_col, text_col=text_col, index=postings)
    if index is None or model is None:
        index, model = text_index(corpus, id_col, text_col)
    hits = advanced_search(requests.where(deep), index, model, exact=exact)
    cols = ["query_id", id_col, "score", "rank"]
    return (basic.select(*cols).unionByName(hits.select(*cols))
            .join(requests.select("query_id", "search_depth"), "query_id").select("query_id", "search_depth", id_col, "score", "rank"))
