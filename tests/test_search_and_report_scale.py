"""SQL search without a row for each (request, document) in the shuffle; reports without a folder for each."""
from pyspark.sql import functions as F

from tessera.functions import sql as fs
from tessera.operators import retrieve as rt


def _case(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(60)] + [(100, None), (None, "w1 w2")],
                                 "doc_id long, text string")
    reqs = spark.createDataFrame([(1, "w1 w2", 5), (2, "W3", 60), (3, "nothing", 5), (4, "w1 w2", 3), (5, None, 3)],
                                 "query_id long, query string, max_results long")
    return docs, reqs


def test_sql_search_over_ranges(spark, monkeypatch):
    docs, reqs = _case(spark)
    monkeypatch.setattr(fs, "SEARCH_RANGE", 5)
    fs.register_search_function(spark, docs.where("doc_id is not null"), view="t_scale_index")
    reqs.createOrReplaceTempView("t_scale_reqs")
    got = spark.sql("SELECT r.query_id, s.doc_id, s.score, s.rank FROM t_scale_reqs r, LATERAL search(r.query, CAST(r.max_results AS INT)) s")
    want = rt.search(docs.where("doc_id is not null"), reqs).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.groupBy("query_id").count().where("query_id = 2").first()["count"] == 50
    # the documents are dealt before the join with the requests, and not again
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("part#" in line for line in dealt) and not any("doc_id#" in line or "_id#" in line for line in dealt)


def test_reports_share_folders(spark, tmp_path):
    from tessera.sources.sinks import read_reports, write_reports
    path = str(tmp_path / "out")
    rep = spark.range(200).select(F.col("id").alias("report_id"), F.concat(F.lit("# é "), F.col("id").cast("string")).alias("body"))
    write_reports(rep.coalesce(2), path, run_ts="20240101_000000")
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_dir()]) < 10
    assert len(list((tmp_path / "out").rglob("*.md"))) == 200
    # another run, an id twice (one file), ids and bodies that are null
    more = spark.createDataFrame([(1, "a"), (1, "b\n"), (None, "x"), (5, None)], "report_id long, body string").coalesce(1)
    write_reports(more, path, run_ts="20240102_000000")
    back = read_reports(spark, path)
    assert back.where("run_ts = '20240101_000000'").count() == 200
    assert {tuple(r) for r in back.where("run_ts = '20240102_000000'").select("report_id", "body").collect()} == {
        (1, "a\nb\n"), (None, "x"), (5, "")}
