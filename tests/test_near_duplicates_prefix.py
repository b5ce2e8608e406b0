"""D3 within band buckets of unlike members: a second key in place of their product."""
import itertools
import random

import pytest

from tessera.operators import dedup as dd


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def templates(n, seed=2):
    """Texts with one long common part: they share bands, few are near copies."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(110)]
    rows = []
    for i in range(n):
        own = [f"o{i}x{j}" for j in range(50)]
        rows.append((i, " ".join(common + own)))
    for i in range(n, n + 40):
        w = rows[r.randrange(n)][1].split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_templates_equal_all_pairs(spark):
    rows = templates(150)
    sets = {i: shingles(t) for i, t in rows}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8 and b not in want:
            want[b] = a
    got = {r.doc_id: r.dup_of for r in dd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = {i for i in want if got.get(i) != want[i]}
    assert set(got) <= set(want) and len(missed) <= 1 and len(want) >= 35


def test_unlike_members_do_not_meet(spark):
    """Of n texts with a common part, far fewer than n * n / 2 pairs share a key."""
    rows = templates(200)
    sets = dd.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = dd.prefix_keys(sets, "doc_id", 0.8)
    met = keys.alias("a").join(keys.alias("b"), "key").where("a.doc_id < b.doc_id").select("a.doc_id", "b.doc_id").distinct().count()
    assert met < 400 < 200 * 200 / 2


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_similar_sets_share_a_key(spark, threshold):
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w for w in base if r.random() < 0.97)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {}
    for k in dd.prefix_keys(dd.shingle_sets(df), "doc_id", threshold).collect():
        keys.setdefault(k.doc_id, set()).add(k.key)
    sets = {i: shingles(t) for i, t in rows}
    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= threshold:
            assert keys[a] & keys[b]


def test_pairs_with_too_few_common_shingles_are_not_verified(spark, monkeypatch):
    """Unlike texts that meet by a rare phrase: before, all pairs of a family were verified."""
    common, rows = [f"c{i}" for i in range(120)], []
    for i in range(96):
        phrase = [f"p{i % 4}x{j}" for j in range(8)]
        rows.append((i, " ".join(common + phrase + [f"o{i}x{j}" for j in range(20)])))
    for i in range(96, 108):                                      # near copies of some
        w = rows[(i * 5) % 96][1].split()
        w[i % 100] = f"z{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8 and b not in want:
            want[b] = a
    verified, seen = dd._verified, []
    monkeypatch.setattr(dd, "_verified", lambda *a, **k: seen.append(a[1].count()) or verified(*a, **k))
    got = {r.doc_id: r.dup_of for r in dd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) == 12
    assert len(seen) == 2 and seen[1] <= 60


def test_words_and_shingles_are_those_of_the_normalised_text(spark):
    from pyspark.sql import functions as F
    from tessera.operators import shingles as sh
    r = random.Random(3)
    parts = ["Abc", "dEF9", "x", "straße", "İstanbul", "ΟΔΟΣ", "汉字", "かな", "𝔘𐐀", "½", "Ⅷ", "é", "é", "٣", "़", "🙂", " ",
             "-", "--", "\t", "\n", "\0", "'", "_", "­", "�", "\U0001F600", "日本", "ǅ", "ẞ", "a" * 70]
    texts = [None, "", " ", "one", "One  two", "one-two", "🙂", "abc", "ab c", "a bc"]
    texts += ["".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts += ["long " + " ".join(r.choice(parts) for _ in range(60_000))]               # one over the size of a chunk
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    plain = {x.doc_id: x for x in df.select("doc_id", norm.alias("n"), F.sha2(norm, 256).alias("h")).filter("n <> ''").collect()}
    sets = {x.doc_id: x.shingles for x in dd.shingle_sets(df).collect()}
    facts = {x.doc_id: x for x in sh.signatures(df, "doc_id", "text", 8).collect()}
    assert set(sets) == set(facts) == set(plain)
    grams = {}
    for i, x in plain.items():
        w = x.n.split(" ")
        grams[i] = {" ".join(w[k:k + 3]) for k in range(len(w) - 2)} or {x.n}
        assert len(sets[i]) == len(set(sets[i])) == len(grams[i]) == facts[i].size and facts[i].words.hex() == x.h, repr(texts[i])
    some = sorted(grams)[:120]
    assert all(len(set(sets[a]) & set(sets[b])) == len(grams[a] & grams[b]) for a, b in itertools.combinations(some, 2))


def test_texts_that_share_no_band_are_read_once(spark, monkeypatch):
    """Their shingles are neither made again nor written: before, the joins came after the text's regular expressions."""
    from tessera.operators import shingles as sh
    made, old = [], sh.shingle_sets
    monkeypatch.setattr(sh, "shingle_sets", lambda df, *a: made.append(df.count()) or old(df, *a))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(5)]
    got = {r.doc_id: r.dup_of for r in dd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {200 + i: i for i in range(5)} and made == [10]
