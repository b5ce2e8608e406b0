"""Top-k by ranges of documents against all pairs; match counts by bits."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import postings as ps
from tessera.operators import retrieve as rt


def corpus(spark, n, seed=1):
    """Stopwords in every text, rare words in few."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"stop{r.randrange(6)}" for _ in range(r.randint(5, 40))] + [f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(r.randint(0, 15))]
        rows.append((i, " ".join(words)))
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(n + 100, None), (n + 101, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def requests(spark):
    r = random.Random(9)
    rows = [(q, " ".join(["stop1 stop2 stop3"] + [f"w{r.randrange(40)}" for _ in range(4)]), q % 13) for q in range(60)]
    rows += [(100, "stop1", 50), (101, "nothing here", 5), (102, "", 5), (103, None, 5), (104, "w1", -1), (105, "stop0 stop0", 80), (106, "w1", None)]
    return spark.createDataFrame(rows, "query_id long, query string, max_results int")


def all_pairs(docs, reqs):
    s = rt.keyword_search(docs, reqs).join(reqs.select("query_id", "max_results"), "query_id")
    return sorted(map(tuple, rt.top_k_per_query(s, F.col("max_results")).select("query_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize("size", [256, 16])
def test_equals_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(ps, "RANGE", size)
    docs, reqs = corpus(spark, 1500), requests(spark)
    assert sorted(map(tuple, rt.search(docs, reqs).select("query_id", "doc_id", "score", "rank").collect())) == all_pairs(docs, reqs)


def test_blocks_of_requests(spark, monkeypatch):
    docs, reqs = corpus(spark, 300), requests(spark)
    want = sorted(map(tuple, rt.search(docs, reqs).collect()))
    monkeypatch.setattr(ps, "BLOCK_REQUESTS", 20)
    assert sorted(map(tuple, rt.search(docs, reqs).collect())) == want


def test_ids_that_are_strings_and_empty_tables(spark):
    docs = corpus(spark, 60).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    reqs = requests(spark)
    assert sorted(map(tuple, rt.search(docs, reqs).select("query_id", "doc_id", "score", "rank").collect())) == all_pairs(docs, reqs)
    assert rt.search(docs.limit(0), reqs).count() == 0 and rt.search(docs, reqs.limit(0)).count() == 0


def test_ranges_are_skipped():
    """One request of a rare and a common word: once its best hits have the rare one, ranges without are skipped."""
    scorer = ps.Scorer({"rare": np.array([0]), "common": np.array([0, 1])}, np.array([3, 2]))
    for r in range(100):
        ids = np.arange(r * 10, r * 10 + 10)
        if r == 0:
            scorer.range(["common", "rare"], np.array([0, 10, 14]), np.concatenate([ids, ids[:4]]), np.array([0.5] * 10 + [9.0] * 4))
        else:
            scorer.range(["common"], np.array([0, 10]), ids, np.full(10, 0.5 - 0.001 * r))
        scorer.best.cut()
    q, score, ids = scorer.best.cut()
    assert list(zip(q, score, ids)) == [(0, 9.5, 0), (0, 9.5, 1), (0, 9.5, 2), (1, 0.5, 0), (1, 0.5, 1)]
    # request 0 is scored in the first range only, the other soon not either
    assert scorer.scored == 2 and scorer.skipped == 198


def test_match_counts(spark):
    docs, reqs = corpus(spark, 700), requests(spark)
    words = {r.doc_id: set(r.t or []) for r in docs.select("doc_id", tokenize("text").alias("t")).collect()}
    want = Counter()
    for q in reqs.select("query_id", tokenize("query").alias("t")).collect():
        want[q.query_id] = sum(bool(words[d] & set(q.t or [])) for d in words)
    assert {r.query_id: r.n_matches for r in rt.match_counts(docs, reqs).collect()} == {q: n for q, n in want.items() if n}
