import numpy as np
import pytest

from tessera.llm import embedding_dedup as op


def brute(rows):
    ok = {}
    for k, (vid, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        ok[k] = (label, x / np.linalg.norm(x))
    links = {k: [j for j in ok if j != k and ok[j][0] == ok[k][0] and len(ok[j][1]) == len(ok[k][1]) and float(ok[j][1] @ ok[k][1]) >= 0.93] for k in ok}
    out = []
    for k, (vid, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((vid, len(links.get(k, [])), comp, vid is not None and vid == comp))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("cell", [1024, 16])
def test_small_table_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(op, "CELL", cell)
    monkeypatch.setattr(op, "MISS", 1e-6)
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + r.standard_normal(16) * r.choice([0.0, 0.1, 0.25, 0.6])).astype(np.float32).tolist(), i % 2) for i in range(240)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, rows[0][1], None), (903, [1.0, None] + [0.0] * 14, 1), (904, [float("nan")] * 16, 0),
             (905, [float("inf")] + [0.0] * 15, 0), (906, [], 0), (907, rows[0][1], 0), (907, rows[0][1], 0), (None, rows[0][1], 0), (None, None, None),
             (908, [3e30] * 16, 1), (909, [1e-30] * 16, 1), (910, [1.0, 2.0], 1), (911, [2.0, 4.0], 1)]
    df = spark.createDataFrame([x + ("x",) * 3 for x in rows], "vec_id long, embedding array<float>, label int, node string, vec string, copies string")
    got = [tuple(x) for x in op.near_duplicates(df).collect()]
    assert sorted(got, key=KEY) == sorted(brute(rows), key=KEY)
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want, got = brute(rows), [tuple(x) for x in op.near_duplicates(df).collect()]
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert there * 0.99 <= found <= there and len(got) == len(rows)


def test_calibration():
    assert op.count_needed(24, 2.0, 1e-3) in range(17, 21) and op.tables_needed(0) == 1
    assert 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** 6) ** op.tables_needed(6) >= 0.999
