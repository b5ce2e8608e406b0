"""D1-D3, C1-C2, W2/W5, L1-L4, TR1, S4 round trip, U3 attempts."""
import itertools

from pyspark.sql import functions as F

from tessera.operators import credibility as cr
from tessera.operators import dedup as dd
from tessera.operators import lint as ln
from tessera.operators import report as rp
from tessera.operators import translate as tl


def test_unique_citations_first_wins(spark):
    ann = spark.createDataFrame([(1, 1, "A", "u1"), (1, 2, "B", "u1"), (1, 3, "", "u2"), (2, 1, None, "u1")],
                                "msg_id long, pos long, title string, url string")
    got = sorted((r.msg_id, r.pos, r.title, r.url) for r in dd.unique_citations(ann).collect())
    assert got == [(1, 1, "A", "u1"), (1, 3, "u2", "u2"), (2, 1, "u1", "u1")]
    md = {r.msg_id: r.references_md for r in rp.references_bullets(dd.unique_citations(ann)).collect()}
    assert md[1] == "\n\n## References\n- [A](u1)\n- [u2](u2)\n"


def test_near_duplicates_against_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x30")
    other = " ".join(f"z{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (3, near), (4, other), (5, "tiny")], "doc_id long, text string")
    got = {r.doc_id: r.dup_of for r in dd.near_duplicates(docs).collect()}
    sets = {r.doc_id: set(r.shingles) for r in dd.shingle_sets(docs).collect()}
    brute = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= dd.NEAR_DUP_THRESHOLD and b not in brute:
            brute[b] = a
    assert got == brute == {2: 1, 3: 1}


def test_near_duplicates_complete_on_templates(spark):
    """Families of texts that differ in two or three words: links between members
    that are not near the family's first text count too, and copies of each."""
    import random
    rnd, rows = random.Random(5), []
    for fam in range(20):
        words = [f"f{fam}w{i}" for i in range(100)]
        for _ in range(15):
            text = list(words)
            for at in rnd.sample(range(100), rnd.choice((2, 3))):
                text[at] = f"x{rnd.randrange(10**6)}"
            rows += [" ".join(text)] * rnd.choice((1, 1, 1, 3))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.dup_of for r in dd.near_duplicates(docs).collect()}
    sets = {r.doc_id: set(r.shingles) for r in dd.shingle_sets(docs).collect()}
    brute = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter / (len(sets[a]) + len(sets[b]) - inter) >= dd.NEAR_DUP_THRESHOLD and b not in brute:
            brute[b] = a
    assert len(brute) > 200 and set(got) <= set(brute)
    assert sum(got.get(b) == a for b, a in brute.items()) >= 0.99 * len(brute)


def test_tiers_label_boundary(spark):
    df = spark.createDataFrame([("www.reuters.com",), ("notreuters.com",), ("U:P@News.BBC.co.uk:443",), ("mit.edu",),
                                ("example.org",)], "domain string")
    got = [r.tier for r in cr.tier_sources(df).collect()]
    assert got == [1, None, 1, 3, None]
    tiers = spark.createDataFrame([("org", 3), ("reuters.com", 1)], "suffix string, tier bigint")
    df2 = df.withColumn("rid", F.monotonically_increasing_id())
    got2 = {r.domain: r.tier for r in cr.tier_sources_table(df2, tiers, "rid").collect()}
    assert got2["example.org"] == 3 and got2["notreuters.com"] is None and got2["www.reuters.com"] == 1


def test_coverage(spark):
    rows = [(1, f"d{i}.com", t) for i, t in enumerate([1, 2, 3, None, None])]
    df = spark.createDataFrame(rows, "query_id long, domain string, tier bigint")
    r = cr.needs_verification(cr.coverage_score(df)).first()
    assert r.coverage == round(0.5 * 1.0 + 0.5 * (1.0 + 0.8 + 0.6 + 0.2 + 0.2) / 5, 4)
    assert r.needs_verification is False


def test_assemble_and_lint(spark):
    secs = spark.createDataFrame([(1, "Background", 1, "B [2]"), (1, "Introduction", 1, "I [1]"),
                                  (1, "Key Findings", 0, "### Sub"), (1, "Key Findings", 1, "K has 12 units.")],
                                 "report_id long, section string, para_pos long, para string")
    titles = spark.createDataFrame([(1, "T")], "report_id long, title string")
    body = rp.assemble_report(secs, titles).first().body
    assert body == "# T\n\n## Introduction\n\nI [1]\n\n## Background\n\nB [2]\n\n## Key Findings\n\n### Sub\n\nK has 12 units."
    full = body + "\n\n## References\n\n1. [S](http://s) - Pub, 2024-01-01\n3. Plain - X, 2024"
    rep = spark.createDataFrame([(1, full)], "report_id long, body string")
    cites = ln.extract_citations(rep)
    refs = ln.parse_references(rep)
    assert [r.n for r in cites.orderBy("cite_pos").collect()] == [1, 2]
    assert sorted(r.n for r in ln.orphan_citations(cites, refs).collect()) == [2]
    assert sorted(r.n for r in ln.unused_references(cites, refs).collect()) == [3]
    st = ln.structure_check(rep).first()
    assert st.n_titles == 1 and st.kf_subsections is True
    assert st.missing_sections == "Analysis,Implications,Conclusion"
    assert [r.sentence for r in ln.uncited_sentences(rep).collect()] == ["K has 12 units."]
    fmt = {r.n: r.format_ok for r in ln.reference_format(refs).collect()}
    assert fmt == {1: True, 3: False}


def test_translation_integrity(spark):
    src = "# T\n\n## A\n\nx [1] [2] ![i](http://img/1.png) [l](http://a)"
    pairs = spark.createDataFrame([(1, src, src.replace("x", "y")), (2, src, src.replace("[2]", "")),
                                   (3, src, src.replace("## A", "### A"))],
                                  "report_id long, source_body string, target_body string")
    got = {r.report_id: (r.citations_ok, r.headings_ok, r.integrity_ok)
           for r in tl.translation_integrity(pairs).collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, False, False)}


def test_write_reports_round_trip(spark, tmp_path):
    from tessera.sources.sinks import read_reports, write_reports
    rep = spark.createDataFrame([(1, "# Ü report\n\nline"), (2, "# two\n")], "report_id long, body string")
    write_reports(rep, str(tmp_path / "out"), run_ts="20240101_000000")
    back = {r.report_id: r.body for r in read_reports(spark, str(tmp_path / "out")).collect()}
    assert back == {1: "# Ü report\n\nline", 2: "# two\n"}


def test_batch_generate_attempts(spark):
    from tessera.operators.generate import batch_generate

    def fn(prompt, attempt):
        if prompt == "bad":
            raise ValueError("no")
        if prompt == "flaky" and attempt < 3:
            raise TimeoutError("later")
        return prompt.upper()
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "flaky")], "id long, p string")
    got = {r.id: (r.output, r.error, r.attempts) for r in batch_generate(df, "id", "p", fn).collect()}
    assert got == {1: ("OK", None, 1), 2: (None, "ValueError: no", 3), 3: ("FLAKY", None, 3)}


def test_report_checks_equal_operator_path(spark):
    body = ("# T\n\n## Introduction\n\nA [1] and 【4:2†source】 [5]\n\n## Key Findings\n\n### S\n\nK [3]\n\n"
            "![a](http://i/1.png)\n*Figure 1: a*\n\n![](http://i/2.png)\n\n## References\n\n"
            "1. [S](http://s) - Pub, 2024-01-01\n- [B](http://b)\n3. Plain - X, 2024\n")
    rep = spark.createDataFrame([(7, body)], "report_id long, body string")
    got = ln.report_checks(rep).first()
    cites, refs = ln.extract_citations(rep), ln.parse_references(rep)
    assert got.n_cited == cites.select("n").distinct().count() == 4
    assert got.n_orphans == ln.orphan_citations(cites, refs).count()
    assert got.n_unlinked == refs.filter(~F.col("linked")).count() == 1
    st, im = ln.structure_check(rep).first(), ln.image_check(rep).first()
    assert (got.structure_ok, got.n_titles, got.missing_sections) == (st.structure_ok, st.n_titles, st.missing_sections)
    assert (got.n_images, got.n_empty_alt, got.n_captioned) == (im.n_images, im.n_empty_alt, im.n_captioned) == (2, 1, 1)
    assert got.has_references is True and got.n_words == ln.length_check(rep).first().n_words


def test_near_duplicates_match_brute_force_on_driver_table(spark):
    from tessera.sources.tables import load
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r.dup_of for r in dd.near_duplicates(docs).collect()}
    sets = {r.doc_id: set(r.shingles) for r in dd.shingle_sets(docs).collect()}
    ids = sorted(sets)
    brute = {}
    for i, b in enumerate(ids):
        for a in ids[:i]:
            inter = len(sets[a] & sets[b])
            if inter / (len(sets[a]) + len(sets[b]) - inter) >= dd.NEAR_DUP_THRESHOLD:
                brute[b] = a
                break
    assert got == brute


def test_rowlocal_reports_equal_w5_assembly(spark):
    from tessera.plans import derived as dv
    d = "/root/testdata/sf0.001"
    a = dv.reports(spark, d).select("report_id", "body")
    b = dv.reports_rowlocal(spark, d).select("report_id", "body")
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
