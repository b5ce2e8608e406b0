"""Q1 parameter rules, BM25 / top-k, filters."""
from pyspark.sql import functions as F

from tessera.operators import requests as rq
from tessera.operators import retrieve as rt


def test_build_search_params(spark):
    rows = [(1, "q", 10, "week", "news", "advanced", True),
            (2, "q", None, None, "general", "basic", False),
            (3, "q", 80, "month", "finance", "basic", None),
            (4, "q", -1, "decade", "x", "y", True)]
    df = spark.createDataFrame(rows, "query_id int, query string, top_k int, time_range string, topic string, "
                                     "search_depth string, include_images boolean")
    got = {r.query_id: r for r in rq.build_search_params(df).collect()}
    assert got[1].max_results == 10 and got[1].time_range == "week" and got[1].include_images is True
    assert got[1].include_image_descriptions is True and got[1].topic == "news"
    assert got[2].max_results == 5 and got[2].time_range is None and got[2].include_images is None
    assert got[3].max_results == 50 and got[3].time_range == "month"
    assert got[4].max_results == -1 and got[4].time_range is None and got[4].topic == "x"
    assert all(r.include_answer is False and r.include_raw_content is False for r in got.values())


def test_bm25_and_topk(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple cherry"), (3, "durian")],
                                 "doc_id long, text string")
    reqs = spark.createDataFrame([(10, "apple", 1), (11, "durian cherry", 5)], "query_id long, query string, max_results long")
    s = rt.keyword_search(docs, reqs)
    got = {(r.query_id, r.doc_id): r.score for r in s.collect()}
    assert set(got) == {(10, 1), (10, 2), (11, 2), (11, 3)}
    assert got[(10, 2)] > got[(10, 1)]
    top = rt.search(docs, reqs).collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in top if r.query_id == 10] == [(10, 2, 1)]


def test_topk_literal_cap_uses_window_group_limit(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"),
                                 (F.col("id") * 1.0).alias("score"))
    out = rt.top_k_per_query(df, F.lit(7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 21
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan


def test_phrase_time_topic_filters(spark):
    df = spark.createDataFrame([(1, 'x "red fox"', "the red fox"), (2, 'x "red fox"', "red the fox"),
                                (3, "no phrase", "anything")], "doc_id int, query string, text string")
    assert sorted(r.doc_id for r in rt.phrase_filter(df).collect()) == [1, 3]
    ev = spark.createDataFrame([(1, "2024-01-30 12:00:00", "day"), (2, "2024-01-20 00:00:00", "day"),
                                (3, "2024-01-20 00:00:00", "month"), (4, None, "week"), (5, None, None)],
                               "id int, ts string, r string").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = rt.time_range_filter(ev, "ts", "r", "2024-01-31 00:00:00").collect()
    assert sorted(r.id for r in kept) == [1, 3, 5]
    t = spark.createDataFrame([(1, "news", "general"), (2, "news", "finance"), (3, "finance", "finance")],
                              "id int, topic string, wanted string")
    assert sorted(r.id for r in rt.topic_filter(t, "topic", "wanted").collect()) == [1, 3]


def test_request_rules(spark):
    df = spark.createDataFrame([(1, "breaking news on markets"), (2, "historical chart of 关于")],
                               "query_id int, query string")
    out = rq.detect_script(rq.wants_images(rq.infer_topic(rq.infer_time_range(df))))
    got = {r.query_id: r for r in out.collect()}
    assert got[1].inferred_time_range == "day" and got[1].inferred_topic == "news"
    assert got[2].inferred_time_range is None and got[2].wants_images is True and got[2].report_lang == "zh"
    assert rq.expand_queries(df).count() == 6


def test_search_topk_equals_exhaustive(spark):
    from tessera.plans import derived as dv
    from tessera.sources.tables import load
    d = "/root/testdata/sf0.001"
    p = dv.params(spark, d)
    docs = load(spark, d, "documents")
    a = sorted(map(tuple, rt.search(docs, p).select("query_id", "doc_id", "score", "rank").collect()))
    b = sorted(map(tuple, rt.search_topk(docs, p).select("query_id", "doc_id", "score", "rank").collect()))
    assert a == b and len(a) > 0
