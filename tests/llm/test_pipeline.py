import re
from collections import Counter

import corpus_pipeline as cp
from tessera.llm import mixing, packing, pii, quality_classifier
from tests.llm.test_rules_packing_simhash_shards import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs if not got else got[-1], SF).write.parquet(str(tmp_path / str(k)))
        got.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert got[-1].dtypes == docs.dtypes
    rows = [[tuple(r) for r in g.collect()] for g in got]
    # 9: what the operator keeps
    kept = {r.doc_id for r in quality_classifier.classify(docs, labels).where("kept").collect()}
    assert Counter(rows[0]) == Counter(tuple(r) for r in docs.collect() if r.doc_id in kept)
    clean = labels.where("quality = 1 and toxic = 0").count()
    assert len({r[0] for r in rows[0]} & {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}) >= 0.95 * clean
    # 6: the smallest id of each group of fingerprints
    fp = {r[0]: brute_fingerprint(r[1]) for r in rows[0]}
    comp = brute_components(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 2)
    assert sorted(r[0] for r in rows[1]) == sorted(d for d in fp if comp[d] == d)
    assert set(rows[1]) <= set(rows[0])
    # 8: redacted texts
    tagger = pii.train(got[1])
    want = {}
    for r in rows[1]:
        extra = pii.tagged(tagger, [r[1]])[0] if tagger and re.search("[0-9@]", r[1]) else []
        text = pii.redact(r[1], pii.all_spans(r[1], extra)[1])
        want[r[0]] = (r[0], text, *r[2:4], len(text))
    assert sorted(rows[2]) == sorted(want.values())
    # 4: as often as drawn
    drawn = Counter({r.doc_id: r.copies for r in mixing.select(got[2], budget_share=cp.MIX_SHARE).collect()})
    assert Counter(r[0] for r in rows[3]) == drawn and set(rows[3]) <= set(rows[2])
    # 5: every token of every row
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    total = sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows[3])
    assert got[4].agg({"length": "sum"}).first()[0] == total
    bins = Counter()
    for r in got[4].collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024 and len(bins) <= 1.05 * total / 1024 + 2


def test_hard_rows(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        d = start
        for _, stage in cp.STAGES:
            d = stage(spark, d, SF).checkpoint()
        n = d.count()
        assert n > 0 if start is docs else n == 0
