"""R5 over the inverted-file index, routed search, and the k-means beneath (M2)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features as ft
from tessera.operators import kmeans as km
from tessera.operators import themes as th
from tessera.operators import vector_index as vi
from tessera.operators import vectors as vc
from tessera.operators.routed import routed_search

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def queries(embeddings):
    return embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@pytest.fixture(scope="module")
def index(embeddings):
    return vi.build_index(embeddings)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect()))


def test_exact_search_equals_all_pairs(embeddings, queries, index):
    assert rows(vi.search(index, queries, k=10, exact=True)) == rows(vc.semantic_search(embeddings, queries, k=10))


def test_calibrated_probes_reach_the_recall(spark, embeddings, queries, index):
    true = {r[:2] for r in rows(vc.semantic_search(embeddings, queries, k=10))}
    found = {r[:2] for r in rows(vi.search(index, queries, k=10))}
    assert len(true & found) >= 0.95 * len(true)
    assert 1 <= index.probes <= len(index.centroids) == 45


def test_recall_on_text_vectors_with_few_cells_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    feats, _ = ft.text_features(docs, "doc_id", "text")
    idx = vi.build_index(feats, "doc_id", "features")
    qs = feats.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("features").alias("query_vec"))
    true = {(r.query_id, r.doc_id) for r in vi.search(idx, qs, k=10, exact=True).collect()}
    found = {(r.query_id, r.doc_id) for r in vi.search(idx, qs, k=10).collect()}
    assert len(true & found) >= 0.95 * len(true)
    assert idx.probes < len(idx.centroids)


def test_only_probed_cells_are_read(queries, index):
    df = vi.search(index, queries.limit(1), k=3, probes=2)
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert {r[0] for r in df.select("query_id").collect()} == {0}


def test_index_is_read_again(spark, queries, index):
    again = vi.load_index(spark, index.path)
    assert again.probes == index.probes and np.array_equal(again.centroids, index.centroids)
    assert rows(vi.search(again, queries, k=4)) == rows(vi.search(index, queries, k=4))


def test_many_blocks_of_queries(monkeypatch, queries, index):
    want = rows(vi.search(index, queries, k=3))
    monkeypatch.setattr(vi, "MAX_QUERIES", 24)
    assert rows(vi.search(index, queries, k=3)) == want


def test_copies_nulls_and_zero_vectors(spark):
    r = np.random.default_rng(5)
    data = [(i, r.standard_normal(8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(400)]
    data += [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [float("nan")] * 8), (2004, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    idx = vi.build_index(df, cells=12)
    qs = spark.createDataFrame([(1, [1.0] * 8, 5), (2, data[3][1], 2), (3, None, 4), (4, [0.0] * 8, 4), (5, [1.0] * 8, -1), (6, [1.0], 3)],
                               "query_id long, query_vec array<double>, k int")
    got = rows(vi.search(idx, qs, k="k", exact=True))
    assert [x[1] for x in got if x[0] == 1] == [1000, 1001, 1002, 1003, 1004]
    assert [x[:3] for x in got if x[0] == 2][0] == (2, 3, 1.0) and {x[0] for x in got} == {1, 2}
    assert idx.vectors(spark).count() == 700
    empty = vi.build_index(df.limit(0))
    assert vi.search(empty, qs, k=3).count() == 0


def test_routing(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta beta gamma"), (3, "delta"), (4, None), (5, "")], "doc_id long, text string")
    reqs = spark.createDataFrame([(1, "beta", 2, "basic"), (2, "beta gamma", 1, "advanced"), (3, "", 3, "advanced"), (4, "delta", -1, "advanced"),
                                  (5, "delta", 80, None), (6, "delta", 3, "deepest")], "query_id long, query string, max_results int, search_depth string")
    got = {(r.query_id, r.search_depth, r.doc_id, r.rank) for r in routed_search(docs, reqs, exact=True).collect()}
    assert got == {(1, "basic", 2, 1), (1, "basic", 1, 2), (2, "advanced", 2, 1), (5, None, 3, 1), (6, "deepest", 3, 1)}


def test_kmeans_rows_join_the_nearest_mean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found, centroids = th.text_themes(docs, "doc_id", "text", k=5, iterations=30)
    feats, _ = ft.text_features(docs, "doc_id", "text")
    x = {r.doc_id: np.array(r.features) for r in feats.collect() if r.features is not None}
    themes = {r.doc_id: r.theme for r in found.collect()}
    sums = np.zeros_like(centroids)
    for i, v in x.items():
        s = np.round(centroids @ v, 9)
        assert themes[i] == int(np.argmax(s))
        sums[themes[i]] += v
    # a fixed point: the centroids are the directions of their members' sums
    assert np.allclose(sums / np.linalg.norm(sums, axis=1, keepdims=True), centroids, atol=1e-9)
    assert all(themes[i] is None for i in themes if i not in x)


def test_themes_of_few_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c d")], "doc_id long, text string")
    found, centroids = th.text_themes(df, "doc_id", "text", k=8)
    got = {r.doc_id: r.theme for r in found.collect()}
    assert got[2] is None and got[3] is None and {got[1], got[4]} == {0, 1} and len(centroids) == 2
    assert th.text_themes(df.limit(0), "doc_id", "text")[0].count() == 0


def test_matrix_of_mixed_rows():
    import pyarrow as pa
    at, x = km.matrix(pa.array([[3.0, 4.0], None, [1.0], [0.0, 0.0], [None, 1.0], [0.0, 2.0]], pa.list_(pa.float32())))
    assert at.tolist() == [0, 5] and np.allclose(x, [[0.6, 0.8], [0, 1]])
