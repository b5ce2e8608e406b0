"""Prefix trie against plain Python on small tables, with short segments and many shards."""
import hashlib
import math
import random
import re
import zlib

import pytest

from tessera.llm.prefix_trie import COLUMNS, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows) -> set:
    convs: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    members: dict[tuple, list] = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(math.fmod(c, 20))   # as SQL: the sign of c
        path = tuple(convs.get(first, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    out = set()
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[:len(q)] == q and len(x) == len(q) + 1 for x in below)]
        ends = ",".join(map(str, sorted(c for c, n in m if n == len(p))))
        out.add((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids), len(leaves),
                 sum((len(members[q]) - 1) * words[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df, **kw):
    rows = [tuple(r) for r in prefix_trie(df, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def family(seed: int, convs: int, longest: int) -> list:
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 400), convs):
        n = r.randint(1, longest)
        same = r.random() < 0.6
        for t in range(n):
            text = f"turn {t}" if same or t < 2 else r.choice(["a b", "a  b c", "", "x"])
            rows.append((c, t, r.choice(["user", "user", None]) if t > 1 and not same else "user", text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,shards", [(256, None), (256, 1), (256, 17), (2, 5), (3, 40), (1, 3)])
def test_equals_brute_force(spark, segment, shards):
    rows = family(3, 120, 9)
    assert found(spark.createDataFrame(rows, SCHEMA), segment=segment, shards=shards) == brute(rows)


def test_many_copies_in_many_shards(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000) for t in range(3 + (c % 7 == 0))]
    rows += [(c, 0, "user", f"other {c % 3}") for c in range(4000, 4100)]
    assert found(spark.createDataFrame(rows, SCHEMA), shards=23) == brute(rows)


@pytest.mark.parametrize("segment", [4, 50])
def test_long_conversations(spark, segment):
    long = [(c, t, "user", f"t{t}") for c in (0, 20, 40) for t in range(60)]
    long += [(60, t, "user", f"t{t}" if t < 33 else f"u{t}") for t in range(75)] + [(80, t, "user", f"t{t}") for t in range(12)]
    rows = long + family(5, 20, 4)
    rows = [r for r in rows if r[0] not in range(0, 81) or r in long]
    assert found(spark.createDataFrame(rows, SCHEMA), segment=segment, shards=4) == brute(rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "null turn first"), (1, 0, None, None), (1, 1, "user", ""),
            (1, 1, "user", ""), (5, 0, "a", "b"), (6, 0, "ab", ""), (7, 3, "a", "b"), (7, 9, "a", "b" * 50000 + " " + "c d " * 9000),
            (2, 0, "user", "Ünï   c d"), (3, 0, "user", "x"), (23, 5, None, "x"), (20, 0, None, None), (27, 0, "user", "gone")]
    schema = SCHEMA + ", depth string, path string, k string, what string, key string"
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], schema)
    assert found(df) == found(df, segment=1, shards=3) == brute(rows)
    out = prefix_trie(df.limit(0))
    assert tuple(out.columns) == COLUMNS and out.count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from tessera.llm.queries import ORACLES, QUERIES
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
        want = con.sql(ORACLES["op11_prefix_trie"]).fetchall()
        got = [tuple(r) for r in QUERIES["op11_prefix_trie"](spark, sf).collect()]
        assert len(got) == len(want) and set(got) == set(want)
