"""Token counts: equal to the library on whole texts, however they are cut."""
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.token_counts import Counter, count_tokens

from .samples import edge_docs

SCHEMA = "doc_id long, text string"


def by_library(rows):
    sp = Counter.of(None).sp
    n = [len(sp.encode(t or "")) for _, t in rows]
    return sorted((d is not None, d, len((t or "").encode()), k, k > 4096) for (d, t), k in zip(rows, n))


def counted(df, **kw):
    return sorted((r[0] is not None, *r) for r in count_tokens(df, **kw).collect())


def test_edge_rows(spark):
    docs = edge_docs(spark)
    assert counted(docs) == by_library([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    out = count_tokens(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_no_text_column_is_read_but_text(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_tokens long, row string")
    assert counted(docs) == by_library([(1, "a b")])


def huge_texts():
    r = random.Random(4)
    parts = ["the", "ing", " ", "  ", "thin", "\n", "a", "\t", "</s>", "\u0001", "ée", "0", "1997", "▁", "漢", "\U0001F600"]
    mixed = ["".join(r.choice(parts) for _ in range(n)) for n in (900, 9000, 20000)]
    # no boundary for thousands of signs: wider overlaps, then the whole text
    alike = ["a" * 9000, " " * 9000, "in" * 6000, "word " * 200 + "=" * 8000 + " word" * 200]
    return [*mixed, *alike, mixed[1], "漢字" * 3000 + " \U0001F600" * 3000]


def test_huge_texts_cut_and_spliced(spark):
    rows = list(enumerate(huge_texts())) + [(3, huge_texts()[3]), (None, huge_texts()[2])]
    assert counted(spark.createDataFrame(rows, SCHEMA), chunk=512, overlap=64) == by_library(rows)


def test_special_strings_are_text(spark):
    rows = [(1, "<s> </s> <unk> <0x41> <pad>"), (2, "<s>" * 4000)]
    assert counted(spark.createDataFrame(rows, SCHEMA), chunk=300, overlap=64) == by_library(rows)


@given(st.text(alphabet="abehinrstu  \n\t▁é漢<>/s0", min_size=2, max_size=80), st.data())
@settings(max_examples=300, deadline=None)
def test_no_merge_crosses_a_proven_position(text, data):
    c = Counter.of(None)
    p = data.draw(st.integers(1, len(text) - 1))
    if c.proven(text.replace(" ", "▁"), p):
        assert c.sp.encode(text) == c.sp.encode(text[:p]) + c.inner.encode(text[p:])


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        count_tokens(spark.createDataFrame([], SCHEMA), chunk=100, overlap=50)


def test_query_equals_the_library(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r[0] is not None, *r) for r in QUERIES["op13_token_counts"](spark, sf).collect())
    assert got == by_library(rows)
