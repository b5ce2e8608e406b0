"""BM25 index: a document's tokens are counted in its own row, the text is read once."""
from collections import Counter
import math

from pyspark.sql import functions as F

from tessera.operators import postings as ps
from tessera.operators import retrieve as rt

DOCS = [(1, "b a b. A"), (1, "a b c d"), (2, None), (3, ""), (None, "a a"), (4, "Ü ü x1")]


def _index(spark, vocab=None):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return rt.build_index(docs, vocab)


def test_index_rows(spark):
    got = Counter(tuple(r) for r in _index(spark).select("_id", "dl", "term", "tf").collect())
    # rows of one id and length are added up, but each has its own length
    want = [(1, 4.0, "a", 3.0), (1, 4.0, "b", 3.0), (1, 4.0, "c", 1.0), (1, 4.0, "d", 1.0), (None, 2.0, "a", 2.0), (4, 3.0, "ü", 2.0),
            (4, 3.0, "x1", 1.0)]
    want += [(1, 4.0, None, None)] * 2 + [(2, -1.0, None, None), (3, 0.0, None, None), (None, 2.0, None, None), (4, 3.0, None, None)]
    null_size = {r.dl for r in _index(spark).where("_id = 2").collect()}
    assert null_size <= {-1.0, None}
    assert Counter((i, None if i == 2 else d, t, f) for i, d, t, f in got.elements()) == Counter((i, None if i == 2 else d, t, f) for i, d, t, f in want)


def test_vocabulary_keeps_the_lengths(spark):
    vocab = spark.createDataFrame([("b",), ("zzz",)], "term string")
    rows = _index(spark, vocab).collect()
    assert sorted((r._id, r.tf) for r in rows if r.term is not None) == [(1, 3.0)]
    assert sum(r.term is None for r in rows) == len(DOCS)


def test_text_is_read_once_and_tasks_follow_the_documents(spark):
    plan = _index(spark, spark.createDataFrame([("b",)], "term string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    weights = spark.range(100).select(F.lit("t").alias("term"), F.col("id").alias("_id"), F.lit(1.0).alias("w"))
    n_docs = 1000 * ps.RANGE
    assert ps.ranged(weights, n_docs).rdd.getNumPartitions() >= math.ceil(1000 / ps.TASK_RANGES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_shuffled_by_their_terms(spark):
    """A frequent term, or the lengths, would all go to one task."""
    vocab = spark.createDataFrame([("b",), ("zzz",)], "term string")
    index = _index(spark, vocab)
    assert "Join" not in _plan(index)
    from tessera.session import materialize
    hits = rt.search(None, spark.createDataFrame([(1, "b zzz", 3)], "query_id long, query string, max_results int"), index=materialize(index, "test-index"))
    assert "SortMergeJoin [term" not in _plan(hits)
    assert [(r.query_id, r.doc_id, r["rank"]) for r in hits.collect()] == [(1, 1, 1)]


def test_a_large_vocabulary_is_joined(spark, monkeypatch):
    vocab = spark.createDataFrame([("a",), ("ü",)], "term string")
    want = Counter(map(tuple, _index(spark, vocab).collect()))
    monkeypatch.setattr(ps, "HELD_TERMS", 1)
    assert Counter(map(tuple, _index(spark, vocab).collect())) == want


def test_rows_of_one_id_are_added_up_across_batches(spark):
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, "a b " if i % 2 else "b c") for i in range(400)], "doc_id long, text string")
    one = Counter(map(tuple, rt.build_index(docs).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert Counter(map(tuple, rt.build_index(docs).collect())) == one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(n for (_, _, t, _), n in one.items() if t is None) == 400
    assert sum(tf for (_, _, t, tf) in one if t == "b") == 400 and len([1 for x in one if x[2] == "b"]) == 8
