"""Spelling variants against plain Python over all pairs of words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling

from .samples import edge_docs

SCHEMA = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows) -> set:
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    nears = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, vs in nears.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(nears[w]), n[form[w]] if form[w] else None))
    return out


def found(df, **kw):
    rows = [tuple(r) for r in spelling.variants(df, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def variants_of(seed: int, bases: int) -> list:
    """Texts of words and of their misspellings, falling in number from form to form."""
    r = random.Random(seed)
    texts = []
    for _ in range(bases):
        w = "".join(r.choice("abeinrstÀéß÷") for _ in range(r.randint(5, 9)))
        for times in (40, 15, 5, 3):
            texts += [" ".join([w.upper() if r.random() < 0.1 else w]) for _ in range(times)]
            i, c = r.randrange(len(w)), r.choice("abeinrsté")
            w = r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
    return texts


@pytest.mark.parametrize("tile", [1024, 7])
def test_small_table_equals_brute_force(spark, tile):
    texts = variants_of(1, 60)
    rows = [(i, " ".join(texts[i::25])) for i in range(25)] + [(None, " ".join(texts[::7])), (3, "x,y; Ünder Ünder ünder ÜNDER")]
    assert found(spark.createDataFrame(rows, SCHEMA), tile=tile) == brute(rows)


def test_all_words_in_one_block(spark):
    """Anagrams: one block and one vector of counts, many tiles."""
    r = random.Random(2)
    words = ["".join(r.sample("abcdefgh", 8)) for _ in range(150)] + ["abcdefg" + c for c in "xyz"]
    rows = [(i, " ".join(words * 3)) for i in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA), tile=16) == brute(rows)


def test_edge_rows_and_long_words(spark):
    docs = edge_docs(spark)
    long = "a" * 3000 + "b" * 3000
    more = [(i, f"{long} {long[:-1]} {long[:10]}c{long[11:]}") for i in range(300, 304)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA))
    assert found(docs) == brute([tuple(r) for r in docs.collect()])


def test_clashing_columns_and_empty_table(spark):
    schema = "doc_id long, text string, word string, n long, block string, t int, root string"
    docs = spark.createDataFrame([(1, "House house HOUSE hovse hovse hovse hovse hovse", "w", 1, "b", 1, "r")], schema)
    assert found(docs) == brute([(1, "House house HOUSE hovse hovse hovse hovse hovse")])
    out = spelling.variants(docs.limit(0))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


words = st.text(alphabet="abé", min_size=1, max_size=7)


@given(words, words)
@settings(max_examples=500, deadline=None)
def test_one_edit(a, b):
    if abs(len(a) - len(b)) < 2:
        x, y = (np.frombuffer(w.encode("latin-1"), np.uint8)[None] for w in sorted((a, b), key=len, reverse=True))
        assert bool(spelling.one_edit(x, y)[0]) == near(a, b)


def test_query_equals_its_sql(spark):
    import duckdb

    from tessera.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.sql(ORACLES["op12_spelling_variants"]).fetchall()
    assert {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, sf).collect()} == set(want) and want
