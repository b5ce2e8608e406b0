"""C4, C5, C6, C7, M3-M8, M10, M11, W3, W4, W6, L9, L10, L12, L13, H8-H10, H13-H15, H17, D4, D5, R7, R8."""
import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import credibility as cr
from tessera.operators import dedup as dd
from tessera.operators import lint as ln
from tessera.operators import report as rp
from tessera.operators import retrieve as rt
from tessera.operators import summarise as sm
from tessera.operators import transcript as tr


def test_facts_corroboration_conflicts(spark):
    docs = spark.createDataFrame([(1, "s1", 'Growth was 12% in 2024-01-05. "Quoted words here" said x.'),
                                  (2, "s2", "Growth was 12%. version 3 and version 4.")],
                                 "doc_id long, source string, text string")
    facts = sm.extract_facts(sm.sentences(docs, "doc_id"), "doc_id")
    kinds = {(r.doc_id, r.fact): r.kind for r in facts.collect()}
    assert kinds[(1, "12%")] == "percent" and kinds[(1, "2024-01-05")] == "date" and kinds[(2, "3")] == "number"
    cor = {r.fact: r.corroborated for r in cr.corroboration(facts.join(docs, "doc_id"), "fact", "source").collect()}
    assert cor["12%"] is True and cor["3"] is False
    # one document that names two versions does not conflict with itself
    assert cr.find_conflicts(sm.keyed_facts(docs, "doc_id"), source="doc_id").count() == 0
    more = docs.unionByName(spark.createDataFrame([(3, "s3", "version 3 only")], docs.schema))
    conf = sorted((r.doc_id, r.key, r.value) for r in cr.find_conflicts(sm.keyed_facts(more, "doc_id"), source="doc_id").collect())
    assert conf == [(2, "version", "3"), (2, "version", "4"), (3, "version", "3")]
    q = sm.extract_quotes(docs, "doc_id").collect()
    assert [(r.doc_id, r.quote) for r in q] == [(1, "Quoted words here")]


def test_gaps_and_scope(spark):
    exp = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, term string")
    found = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert [r.term for r in cr.coverage_gaps(exp, found).collect()] == ["b"]
    ev = spark.createDataFrame([(1, "x", dt.datetime(2024, 1, 1)), (2, "x", dt.datetime(2024, 1, 20)),
                                (1, "y", dt.datetime(2024, 1, 10))], "user_id long, event_type string, ts timestamp")
    sc = {r.event_type: (r.n, r.span_days, r.recent_share) for r in cr.scope_profile(ev).collect()}
    assert sc["x"] == (2, 19, 0.5) and sc[None] == (3, 19, round(1 / 3, 4))


def test_summary_budget_and_render(spark):
    sents = spark.createDataFrame([(1, 1, 1, "a b c.", 500), (1, 1, 2, "d.", 600), (1, 2, 1, "e.", 200)],
                                  "query_id long, rank long, sent_pos long, sentence string, n_tokens long")
    s = sm.extractive_summary(sents, "query_id", ["rank", "sent_pos"])
    assert [r.running_tokens for r in s.orderBy("rank", "sent_pos").collect()] == [500, 1100]
    fl = sm.summary_flags(s, "query_id").first()
    assert fl.summary_tokens == 1100 and fl.too_short is False
    assert sm.render_summary(s, "query_id", ["rank", "sent_pos"]).first().summary_md == "## Themes\n- a b c.\n- d."


def test_trend_timeline_theme(spark):
    ev = spark.createDataFrame([(1, "v", dt.datetime(2024, 1, 1, 5)), (2, "v", dt.datetime(2024, 1, 1, 6)),
                                (3, "v", dt.datetime(2024, 1, 3))], "event_id long, event_type string, ts timestamp")
    t = [(r.n, r.prev_n, r.change) for r in sm.trend(ev, "ts", "event_type").orderBy("period").collect()]
    assert t == [(2, None, None), (1, 2, -1)]
    tl = [r.seq for r in sm.timeline(ev.withColumn("u", F.lit(1)), "u", "ts", "event_id").orderBy("event_id").collect()]
    assert tl == [1, 2, 3]
    res = spark.createDataFrame([(1, 10, 0.5, "s1"), (1, 11, 0.9, "s1"), (1, 12, 0.7, "s2")],
                                "query_id long, doc_id long, score double, source string")
    rk = {r.doc_id: r.theme_rank for r in sm.rank_in_theme(res, ["query_id", "source"]).collect()}
    assert rk == {11: 1, 10: 2, 12: 1}
    ts = {(r.query_id, r.source): r.share for r in sm.theme_sources(res, "query_id", "source").collect()}
    assert ts == {(1, "s1"): round(2 / 3, 4), (1, "s2"): round(1 / 3, 4)}


def test_report_helpers(spark):
    refs = spark.createDataFrame([(1, 1, "T", "http://u", "Pub", "2024-01-01")],
                                 "report_id long, n long, title string, url string, publication string, date string")
    assert rp.references_numbered(refs).first().line == "1. [T](http://u) - Pub, 2024-01-01"
    m = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3)], "report_id long, source string, pos long")
    assert {(r.source, r.pos): r.number for r in rp.number_citations(m).collect()} == \
        {("b", 1): 1, ("a", 2): 2, ("b", 3): 1}
    imgs = spark.createDataFrame([(1, i, f"u{i}", f"alt{i}") for i in range(7)], "report_id long, pos long, url string, alt string")
    ch = rp.choose_images(imgs).orderBy("figure_no").collect()
    assert len(ch) == 5 and ch[0].caption == "*Figure 1: alt0*"
    parts = spark.createDataFrame([(["  a \n", "b\t"],)], "parts array<string>")
    assert rp.join_parts(parts).first().body == "a\n\nb"


def test_quality_band_feedback_delta(spark):
    checks = spark.createDataFrame([(1, 1200, 3, 0, True, 0, True, 1, 0, 0, 0)],
                                   "report_id long, n_words long, n_cited long, n_orphans long, has_references boolean, "
                                   "n_unlinked long, structure_ok boolean, n_titles long, n_images long, "
                                   "n_empty_alt long, n_captioned long")
    q = ln.quality_band(ln.quality_score(checks)).first()
    assert q.quality == 1.0 and q.band == "exceptional"
    bad = checks.withColumn("has_references", F.lit(False)).withColumn("n_orphans", F.lit(3).cast("long"))
    qb = ln.quality_score(bad).first()
    assert qb.quality == round(0.30 + 0.0 + 0.25 + 0.10 - 0.20 - 0.15, 6)
    iss = spark.createDataFrame([(1, "images", "i"), (1, "citations", "c"), (1, "content", "t")],
                                "report_id long, category string, message string")
    assert ln.feedback_list(iss).first().feedback == "c; t; i"
    rev = spark.createDataFrame([(1, 1, 0.5, ["short", "no_numbers"]), (1, 2, 0.7, ["no_numbers", "x"])],
                                "thread_id long, revision long, score double, issues array<string>")
    d = {r.revision: (r.delta, r.fixed, r.introduced) for r in ln.revision_delta(rev).collect()}
    assert d == {1: (None, "", "no_numbers,short"), 2: (0.2, "short", "x")}


def test_handoffs_roundrobin_runs(spark):
    msgs = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (1, 2, "system")],
                                 "thread_id long, turn long, role string")
    rr = [(r.expected, r.conforms, r.round) for r in
          tr.round_robin_conformance(msgs, ["user", "assistant"]).orderBy("turn").collect()]
    assert rr == [("user", True, 1), ("assistant", True, 1), ("user", False, 2)]
    ev = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, "b")],
                               "u long, s long, st string")
    trans = tr.transitions(ev, "u", ["s"], "st")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    assert [(r.source, r.target) for r in tr.handoff_conformance(trans, edges).collect()] == [("b", "c")]
    cnt = {(r.source, r.target): (r.n, r.share) for r in tr.handoff_counts(trans).collect()}
    assert cnt == {("a", "b"): (2, 1.0), ("b", "c"): (1, 1.0)}
    runs = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), "queued", None),
                                  (1, 2, dt.datetime(2024, 1, 2), "failed", "boom"),
                                  (2, 3, dt.datetime(2024, 1, 1), "in_progress", None)],
                                 "run_id long, event_id long, ts timestamp, status string, last_error string")
    ro = {r.run_id: (r.status, r.active, r.last_error, r.produces_report) for r in tr.run_outcome(runs).collect()}
    assert ro == {1: ("failed", False, "boom", False), 2: ("in_progress", True, None, False)}


def test_escalation_deliverable_final(spark):
    rev = spark.createDataFrame([(1, 1, 0.79), (2, 1, 0.5), (2, 2, 0.5), (2, 3, 0.5), (3, 1, 0.9)],
                                "thread_id long, turn long, quality double")
    dec = tr.iteration_decision(rev)
    esc = {r.thread_id: (r.escalate, r.reason) for r in tr.escalations(dec).collect()}
    assert esc == {1: (True, "borderline quality"), 2: (True, "revision cycles"), 3: (False, None)}
    cov = spark.createDataFrame([(1, 0.8), (3, 0.9), (2, 0.9)], "thread_id long, coverage double")
    dl = {r.thread_id: r.deliverable for r in tr.deliverable(cov, dec, "thread_id").collect()}
    assert dl == {1: False, 2: False, 3: True}
    m = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "thread_id long, turn long, text string")
    assert tr.final_result(m).first().final_value == "b"


def test_diversify_mix_merge_rerank(spark):
    res = spark.createDataFrame([(1, p, "d1" if p < 4 else "d2", 1.0 - p / 10) for p in range(1, 6)],
                                "query_id long, page_id long, domain string, score double")
    assert sorted(r.page_id for r in dd.diversify(res).collect()) == [1, 2, 4, 5]
    mix = {(r.lang, r.level): r.n for r in dd.source_mix(
        spark.createDataFrame([("a", "en"), ("a", "fr"), ("b", "en")], "source string, lang string")).collect()}
    assert mix[(None, 3)] == 3
    a = spark.createDataFrame([(1, 7, 0.5)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.1)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.score, r.rank) for r in rt.merge_searches(a, b).orderBy("rank").collect()] == \
        [(7, 0.9, 1), (8, 0.1, 2)]
    tiered = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 0.5, 1)], "query_id long, page_id long, score double, tier long")
    rr = [(r.page_id, r.rerank_score) for r in rt.rerank(tiered, id_col="page_id").orderBy("rank").collect()]
    assert rr == [(2, 0.5), (1, 0.2)]


def test_themes_attribution_and_iterations(spark):
    from tessera.operators import transcript as tr
    s = spark.createDataFrame([(1, "s2", 1, 1, "a 5.", ["5"]), (1, "s1", 2, 1, "b.", []), (1, "s2", 3, 1, "c.", [])],
                              "query_id long, source string, rank long, sent_pos long, sentence string, evidence array<string>")
    extra = spark.createDataFrame([(1, "gaps", 2, "y"), (1, "gaps", 1, "x")], "query_id long, section string, pos long, line string")
    md = sm.render_themes(s, "query_id", "source", ["rank", "sent_pos"], extra).first().summary_md
    assert md == ("## Major Theme 1: s2\n• a 5.\n  ◦ 5\n• c.\n\n## Major Theme 2: s1\n• b.\n\n## Emerging Trends and Patterns\n• none"
                  "\n\n## Visual Content Summary\n• none\n\n## Data Gaps and Limitations\n• x\n• y")
    none = sm.render_themes(s, "query_id", "source", ["rank", "sent_pos"], extra.limit(0)).first().summary_md
    assert none.endswith("## Data Gaps and Limitations\n• none")
    used = spark.createDataFrame([(1, "u", None, ""), (1, "u", 2, "2024-01-02")],
                                 "query_id long, url string, tier long, published_date string")
    assert tuple(sm.source_attribution(used, "query_id").first()) == (1, "u", 2, 2, "2024-01-02")
    m = spark.createDataFrame([(1, 1, "ITERATION_COUNT: 1"), (1, 3, "ITERATION_COUNT:1"), (1, 5, "none"),
                               (1, 7, "ITERATION_COUNT:" + "9" * 20)], "thread_id long, turn long, text string")
    got = [(r.iteration, r.marker, r.agrees) for r in tr.compare_iterations(m).orderBy("turn").collect()]
    assert got == [(1, 1, True), (2, 1, False), (3, None, None), (4, None, None)]


def test_lint_of_reports_is_done_once(spark):
    """TR2: the filter on the quality does not do the lint of the reports again."""
    from tessera.plans import q_reports
    for q in (q_reports.q_translation_per_thread, q_reports.q_translation_needed):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
    body = q_reports._reports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert body.count("split(text") == 1


def test_reports_of_empty_lines_are_none(spark, tmp_path):
    from tessera.plans import derived
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "\n a"), (5, " "), (6, "a\n\nb")]
    df = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.report_id: r.body for r in derived.reports_rowlocal(spark, str(tmp_path)).collect()}
    assert sorted(got) == [4, 5, 6]
    assert got == {r.report_id: r.body for r in derived.reports(spark, str(tmp_path)).collect()}
