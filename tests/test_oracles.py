"""Registered queries vs their DuckDB oracles on the smallest scale factor
(a cross-section of every operator family; scripts/check_oracles.py runs
them all at sf0.01)."""
import math

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("events documents embeddings pages benchmark labels conversations").split()
NAMES = ["search_params", "keyword_search", "normalise_results", "parse_responses_results", "validate_batches",
         "attach_images", "unique_citations", "drop_exact_duplicates", "diversify", "tier_sources_table",
         "coverage_score", "extract_facts", "timeline", "new_message_polls", "assemble_chunks", "needs_user_input",
         "iteration_decision", "assemble_report", "parse_references", "quality_score", "translation_integrity",
         "theme_clusters", "sql_search", "stream_assemble_chunks"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in sdf.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    srows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=key)
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    assert len(srows) == len(drows)
    assert srows == drows
