"""Merged and reranked lists are not cut; reference vectors beyond one block."""
import pytest

from tessera.operators import lint as ln
from tessera.operators import retrieve as rt
from tessera.operators import transcript as tr
from tessera.operators import vectors as vc


def test_merge_and_rerank_keep_all_rows(spark):
    s = lambda lo: spark.range(lo, lo + 50).selectExpr("1L as query_id", "id as doc_id", "cast(id as double) as score")
    merged = rt.merge_searches(s(0), s(50))
    assert merged.count() == 100 and merged.agg({"rank": "max"}).first()[0] == 100
    again = rt.rerank(merged.selectExpr("*", "cast(1 as bigint) as tier"))
    assert again.count() == 100


def test_more_query_vectors_than_one_block(spark):
    queries = spark.range(300).selectExpr("id as query_id", "array(cos(id * 0.01D), sin(id * 0.01D)) as query_vec")
    vectors = spark.range(60).selectExpr("id as vec_id", "array(cos(id * 0.05D), sin(id * 0.05D)) as embedding", "cast(id % 40 as int) as label")
    rows = lambda n: sorted(map(tuple, vc.semantic_search(vectors, queries, k=55, max_queries=n).collect()))
    assert rows(4096) == rows(64) and len(rows(64)) == 300 * 55
    themes = lambda n: sorted(map(tuple, vc.theme_clusters(vectors, max_themes=n).collect()))
    assert themes(4096) == themes(7)


@pytest.mark.parametrize("digits", ["7", "9" * 25])
def test_long_numbers_do_not_end_the_job(spark, digits):
    body = f"# T\nA claim [{digits}] and one [2].\n\n## References\n[{digits}] [T](http://a.b/c) - P, 2024\n"
    rep = spark.createDataFrame([(1, body)], "report_id long, body string")
    n = {r.n for r in ln.extract_citations(rep).collect()}
    assert n == ({7, 2} if digits == "7" else {2})
    assert ln.parse_references(rep).count() >= 0 and ln.report_checks(rep).count() == 1
    msg = spark.createDataFrame([(f"ITERATION_COUNT:{digits}",)], "text string")
    assert tr.iteration_marker(msg).first().marker == (7 if digits == "7" else None)


def test_length_in_the_dominant_script(spark):
    rep = spark.createDataFrame([(1, "word " * 1300 + "漢"), (2, "漢" * 1300)], "report_id long, body string")
    assert all(r.length_ok for r in ln.length_check(rep).collect())
    assert all(r.n_words >= 1300 for r in ln.report_checks(rep).collect())
