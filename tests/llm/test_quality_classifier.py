from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import quality_classifier as op
from tessera.llm import textnum as tn


def test_held_out_accuracy(spark):
    """Fitted on the documents with an even id, judged on the labelled others."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = op.train(docs, labels.where("doc_id % 2 = 0"))
    assert model.pseudo > 0
    rows = op.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "p_text", "p_meta", "score", "quality", "toxic").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in rows if r.quality == 0 and r.toxic == 0]
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.25
    assert all(0 <= x <= 1 for r in rows for x in (r.p_text, r.p_meta, r.score))
    # calibrated: the mean score is close to the share of good ones
    assert abs(np.mean([r.score for r in rows]) - len(good) / len(rows)) < 0.05


def test_edge_rows(spark, edge_docs):
    some = [(7, 1, 0), (8, 1, 0), (9, 0, 0), (12, 1, 1), (17, 0, 0), (18, None, None), (None, 1, 0), (7, 1, None)]
    labels = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1 and toxic = 0")):
        out = op.classify(edge_docs, lab).collect()
        assert len(out) == edge_docs.count() and all(r.kept == (r.score >= 0.5) for r in out)
    assert op.classify(edge_docs.limit(0), labels).count() == 0
    assert all(r.kept for r in op.classify(edge_docs, labels.limit(0)).collect())


def test_features_do_not_depend_on_chunks(edge_docs):
    rows = edge_docs.collect()
    col = pa.array([r.text for r in rows])
    def feats(size):
        out = []
        for t in tn.chunks(col, size):
            a, b = op.features(t, [r.lang for r in rows][t.lo:t.hi], [r.source for r in rows][t.lo:t.hi])
            out += [(x.tolist(), y.tolist()) for x, y in zip(a, b)]
        return out
    assert feats(100) == feats(1 << 30)


def _plain(docs, labels, rounds=op.ROUNDS):
    """The model by loops over all rows: documents one by one, counts in dictionaries."""
    worst = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            y = int(r.quality == 1 and (r.toxic or 0) == 0)
            worst[r.doc_id] = min(y, worst.get(r.doc_id, 1))
    rows = []
    for r in docs:
        text, meta = op.features(next(iter(tn.chunks(pa.array([r.text], pa.string())))), [r.lang], [r.source])
        h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42)
        rows.append((h - (h >> 63 << 64), r, text[0], meta[0]))
    known = {}
    for h, r, text, meta in rows:
        if r.doc_id in worst:
            rank = (1 if r.text is None else -len(r.text), r.text or "", r.lang or "", r.source or "")
            known[r.doc_id] = min(known.get(r.doc_id, (rank, 0, h, text, meta)), (rank, 0, h, text, meta), key=lambda x: x[0])
    known = sorted(((h, worst[i], text, meta) for i, (_, _, h, text, meta) in known.items()), key=lambda x: x[0])
    free = [(text, meta) for _, r, text, meta in rows if r.doc_id not in worst]

    def exchange(vt, st, vm, sm):
        docs, found = [Counter(), Counter()], [Counter(), Counter()]
        for text, meta in free:
            pt = op._sigmoid(np.clip(vt.w[text].sum() + vt.b, -30, 30) * st[0] + st[1])
            pm = op._sigmoid(np.clip(vm.w[meta].sum() + vm.b, -30, 30) * sm[0] + sm[1])
            for k, (p, other, feats) in enumerate(((pm, pt, text), (pt, pm, meta))):
                judged = 1 if p >= op.SURE and other > 1 - op.SURE else 0 if p <= 1 - op.SURE and other < op.SURE else None
                if judged is not None:
                    docs[k][judged] += 1
                    found[k].update((judged, int(f)) for f in feats)
        out = []
        for k, dim in enumerate((op.DIM, op.META_DIM)):
            counts = np.zeros((2, dim), np.int64)
            for at, n in found[k].items():
                counts[at] = n
            out.append(op.Handed(np.array([docs[k][0], docs[k][1]]), counts))
        return out

    return op.fit([x[2] for x in known], np.stack([x[3] for x in known]), np.array([x[1] for x in known]), exchange, rounds)


def test_training_equals_loops_over_all_rows(spark, edge_docs):
    """Every document outside the sample takes part in every round, however the rows are dealt."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    some = base.unionByName(edge_docs.select(*base.columns).withColumn("doc_id", edge_docs.doc_id + 10_000_000))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 3 = 0")
    plain = _plain(some.collect(), labels.collect())
    unlabelled = some.join(labels, "doc_id", "left_anti").count()
    assert 0 < plain.pseudo < 2 * unlabelled
    for docs in (some, some.repartition(7)):
        model = op.train(docs, labels)
        assert model.pseudo == plain.pseudo
        for a, b in ((model.text, plain.text), (model.meta, plain.meta), (model.mix, plain.mix), (model.scale_text, plain.scale_text)):
            assert np.allclose(a, b, atol=1e-6)


def test_logistic_equals_a_dense_one():
    """Mini-batches of dense rows, weights started from the log odds of rows and handed counts."""
    r = np.random.default_rng(1)
    dim, y = 12, r.integers(0, 2, 200)
    x = (r.random((200, dim)) < np.where(y[:, None] == 1, 0.3, 0.6) * np.linspace(0.2, 1, dim)).astype(float)
    x[:, 0] = 1
    handed = op.Handed(np.array([500, 40]), np.stack([r.integers(0, 500, dim), r.integers(0, 40, dim)]))
    got = op.Logistic(dim, [np.flatnonzero(v) for v in x], y, handed, odds=0.5, epochs=3)
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = np.minimum(1, n / handed.docs)
    c = np.stack([x[y == 0].sum(0), x[y == 1].sum(0)]) + share[:, None] * handed.counts
    m = n + share * handed.docs
    w = 0.5 * (np.log((c[1] + 0.5) / (m[1] + 1)) - np.log((c[0] + 0.5) / (m[0] + 1)))
    b, g2, gb, rng = 0.0, np.full(dim, 1e-8), 1e-8, np.random.default_rng(5)
    cost = np.sqrt(np.where(y == 1, 200 / (2 * n[1]), 200 / (2 * n[0])))
    for _ in range(3):
        for idx in np.array_split(rng.permutation(200), 3):
            err = (1 / (1 + np.exp(-(x[idx] @ w + b))) - y[idx]) * cost[idx]
            seen = x[idx].any(0)
            g = np.where(seen, x[idx].T @ err + 1e-5 * len(idx) * w, 0)
            g2 += g * g
            w = w - 0.3 * g / np.sqrt(g2)
            gb += err.sum() ** 2
            b -= 0.3 * err.sum() / np.sqrt(gb)
    assert np.allclose(got.w, w) and np.isclose(got.b, b)


def test_columns_with_the_new_names_give_way(spark, edge_docs):
    from pyspark.sql import functions as F
    labels = spark.createDataFrame([(7, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    out = op.classify(edge_docs.withColumn("Score", F.lit("x")).withColumn("h", F.lit(1)).withColumn("y", F.lit(5)), labels)
    assert "Score" not in out.columns and dict(out.dtypes)["score"] == "double" and out.count() == edge_docs.count()
