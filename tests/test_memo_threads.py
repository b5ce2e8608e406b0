"""Written searches follow their tables; translations once for each thread; reports after failures."""
import shutil

from pyspark.sql import functions as F

from tessera.operators import transcript as tr
from tessera.operators import translate as tl
from tessera.plans import derived as dv

SF = "/root/testdata/sf0.001"


def test_a_rewritten_table_is_searched_again(spark, tmp_path):
    for t in ("documents", "benchmark", "pages"):
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    d = str(tmp_path)
    first = dv.doc_search(spark, d)
    assert dv.doc_search(spark, d) is first
    n = first.count()
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20").toPandas()
    rows.to_parquet(tmp_path / "documents.parquet")
    again = dv.doc_search(spark, d)
    assert again is not first and 0 < again.count() < n and again.agg(F.max("doc_id")).first()[0] < 20


def test_translation_once_for_each_thread(spark):
    rows = [(1, 1, "en", True), (2, 1, "en", True), (3, 1, "en", False), (4, 2, "zh", True), (5, 3, "de", True), (6, 4, "en", False)]
    r = spark.createDataFrame(rows, "report_id long, thread_id long, lang string, approved boolean")
    none = r.limit(0)
    assert {x.report_id for x in tl.translation_needed(r, none, thread="thread_id").collect()} == {2, 5}
    done = spark.createDataFrame([(3,)], "thread_id long")
    assert {x.report_id for x in tl.translation_needed(r, done, thread="thread_id").collect()} == {2}
    assert {x.report_id for x in tl.translation_needed(r, none).collect()} == {1, 2, 5}


def test_reports_after_a_failure(spark):
    rows = [(1, 1, 1, "failed", "e"), (2, 1, 2, "failed", "e"), (3, 1, 3, "completed", None), (4, 1, 4, "queued", None), (5, 1, 5, "completed", None)]
    ev = spark.createDataFrame(rows, "run_id long, ts long, event_id long, status string, last_error string")
    answered = spark.createDataFrame([(1,), (3,), (4,)], "run_id long")
    out = {r.run_id: r.produces_report for r in tr.run_outcome(ev, answered=answered).collect()}
    assert out == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert {r.run_id: r.produces_report for r in tr.run_outcome(ev).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True}
