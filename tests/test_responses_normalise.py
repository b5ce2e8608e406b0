"""S2 parsing, N1-N7 rules (FIXTURES.md §1)."""
import json

from pyspark.sql import functions as F

from tessera.operators import normalise as nz
from tessera.sources import responses as rs


def _resp(spark, rows):
    return spark.createDataFrame(rows, "query_id long, response string")


def test_parse_two_results_order_and_defaults(spark):
    body = {"results": [
        {"url": "https://www.example.com/a", "title": "A", "content": "c1", "score": 0.85,
         "published_date": "2025-06-01"},
        "junk", 5,
        {"url": "https://reuters.com/b", "content": "c2", "score": 0.78, "published_date": "2025-06-02",
         "raw_content": "x" * 600}]}
    df = _resp(spark, [(1, json.dumps(body))])
    res = rs.parse_results(df).orderBy("rank").collect()
    assert [r.rank for r in res] == [1, 2]
    assert res[1].has_title is False and res[0].has_title is True
    norm = nz.normalise_results(rs.parse_results(df)).orderBy("rank").collect()
    assert norm[0].domain == "www.example.com" and norm[1].domain == "reuters.com"
    assert norm[1].title == "" and norm[0].snippet == "c1"
    assert norm[1].raw_content == "x" * 497 + "..." and norm[0].raw_content is None
    assert norm[0].crawled_at is not None


def test_parse_errors_and_null_results(spark):
    df = _resp(spark, [(1, '{"results": null}'), (2, "not json"), (3, "[1, 2]"), (4, "{}"), (5, '"text"')])
    assert rs.parse_results(df).count() == 0
    errs = {r.query_id: r.error for r in rs.parse_errors(df).collect()}
    assert set(errs) == {2, 3, 5}
    assert errs[2] == rs.ERR_BAD_JSON and errs[3] == rs.ERR_NOT_OBJECT


def test_validate_quarantine_errors(spark):
    df = _resp(spark, [(1, json.dumps({"results": [{"url": "u", "title": "t", "content": "c"}]})),
                       (2, json.dumps({"results": [{"url": "u", "content": "c"}]})),
                       (3, json.dumps({"results": []})), (4, "bad")])
    raw = rs.parse_results(df)
    v = {r.query_id: (r.n_results, r.valid) for r in nz.validate_batches(df, raw).collect()}
    assert v == {1: (1, True), 2: (1, False), 3: (0, False), 4: (0, False)}
    q = {r.query_id: (r.status, r.reason) for r in nz.quarantine(raw).collect()}
    assert q == {1: ("valid", None), 2: ("rejected", "missing title")}
    e = {r.query_id: r.status for r in nz.error_rows(df, rs.parse_errors(df)).collect()}
    assert e == {1: "ok", 2: "ok", 3: "ok", 4: "error"}


def test_attach_images_first_result_only(spark):
    res = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, rank long")
    imgs = spark.createDataFrame([(1, 1, "http://i/1", "one"), (1, 2, "", "no url"), (1, 3, "http://i/3", "three"),
                                  (2, 1, "http://i/x", "")], "query_id long, img_pos long, url string, description string")
    out = {(r.query_id, r.rank): r.images for r in nz.attach_images(res, imgs).collect()}
    assert [i.markdown for i in out[(1, 1)]] == ["![one](http://i/1)", "![three](http://i/3)"]
    assert out[(1, 2)] is None and out[(2, 1)] is None


def test_result_count_and_profile(spark):
    reqs = spark.createDataFrame([(1,), (2,)], "query_id long")
    res = spark.range(25).select(F.lit(1).cast("long").alias("query_id"), F.lit("t").alias("title"),
                                 F.lit("abc").alias("snippet"), F.lit(None).cast("string").alias("raw_content"))
    chk = {r.query_id: (r.n_results, r.out_of_range) for r in nz.result_count_check(res, reqs).collect()}
    assert chk == {1: (25, False), 2: (0, True)}
    prof = nz.field_profile(res).first()
    assert prof.n_results == 25 and prof.n_titled == 25 and prof.avg_snippet_len == 3.0 and prof.n_raw_null == 25


def test_images_off_gate(spark):
    res = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, rank long")
    imgs = spark.createDataFrame([(1, 1, "http://i/1", "one"), (2, 1, "http://i/2", "two")],
                                 "query_id long, img_pos long, url string, description string")
    params = spark.createDataFrame([(1, True), (2, None)], "query_id long, include_images boolean")
    out = {r.query_id: r.images for r in nz.attach_images(res, imgs, params=params).collect()}
    assert [i.url for i in out[1]] == ["http://i/1"] and out[2] is None


def test_results_field_types(spark):
    df = _resp(spark, [(1, '{"results": 5}'), (2, '{"results": "abc"}'), (3, '{"results": true}'),
                       (4, '{"results": {"a": 1}}'), (5, '{"other": 1}')])
    assert rs.parse_results(df).count() == 0
    errs = {r.query_id: r.error for r in rs.parse_errors(df).collect()}
    assert errs == {1: rs.ERR_NOT_ITERABLE, 3: rs.ERR_NOT_ITERABLE}


def test_null_url_quarantined_not_whole_batch(spark):
    df = _resp(spark, [(1, json.dumps({"results": [{"url": None, "title": "t", "content": "c"},
                                                   {"url": "http://a.org/x", "title": "t", "content": "c"}]}))])
    q = {r.rank: (r.status, r.reason) for r in nz.quarantine(rs.parse_results(df)).collect()}
    assert q == {1: ("rejected", "null url"), 2: ("valid", None)}
