import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import graph, packing, quality_rules, sharding, simhash, textnum

WORD = re.compile("[^\x20\x09-\x0D]+")


# ---- quality rules ----
def measures(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_ledger_equals_brute_force(spark, edge_docs, small_docs):
    for docs in (edge_docs, small_docs):
        want = sorted(((r.doc_id if r.doc_id is not None else -99), *measures(r.text)) for r in docs.collect())
        got = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -99), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert bool(r.failed & quality_rules.policy_mask("base")) == base
            assert r.kept == (r.failed & quality_rules.policy_mask(quality_rules.POLICY) == 0)
    assert quality_rules.ledger(edge_docs.limit(0)).count() == 0


def test_ablations_count_what_one_rule_alone_drops(spark, small_docs):
    led = quality_rules.ledger(small_docs)
    masks = [r.failed for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_docs) == (sum(m & bit != 0 for m in masks), masks.count(bit), len(masks))


def test_chunks_of_one_text_or_many_agree(small_docs):
    col = pa.array([r.text for r in small_docs.collect()])
    whole = [quality_rules.measure(t) for t in textnum.chunks(col, 1 << 30)]
    cut = [quality_rules.measure(t) for t in textnum.chunks(col, 1000)]
    for k in quality_rules.MEASURES:
        assert np.array_equal(np.concatenate([x[k] for x in whole]), np.concatenate([x[k] for x in cut]))


# ---- packing ----
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_tokenizer())


def test_encoder_equals_tokenizer(tokenizer, small_docs):
    from tests.llm.samples import edge_texts
    texts = edge_texts() + [r.text for r in small_docs.collect()] + [
        " lead", "\n\nx", "  y", "a \n b", "a\t b  ", "x  \n", " ", "\t", "9 9a a9", "!? ?!", "été ÀÖØöøɏ", "5×3÷2", "'s 's it's", "< |"]
    r = random.Random(5)
    texts += ["".join(r.choice(" \n\tab1é.,-_") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    encode = packing.Encoder(packing.default_tokenizer())
    for size in (300, 1 << 22):
        got = []
        for t in textnum.chunks(pa.array(texts), size):
            ids, counts = encode(t)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_packing(rows, texts, tokenizer, capacity=1024, max_docs=10 ** 9, max_attention=1e18):
    want = Counter()
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity and len(b) <= max_docs
        assert len(b) == 1 or sum(n * n for _, n in b) <= max_attention
    return bins


def test_packing_places_every_token(spark, edge_docs, small_docs, tokenizer):
    for docs in (edge_docs, small_docs):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        bins = check_packing(packing.pack(docs).collect(), texts, tokenizer)
        total = sum(n for b in bins.values() for _, n in b)
        assert len(bins) <= 1.1 * total / 1024 + 2
    assert packing.pack(edge_docs.limit(0)).count() == 0


def test_every_capacity_binds(spark, small_docs, tokenizer):
    texts = [(r.doc_id, r.text) for r in small_docs.collect()]
    for rule in ("norm", "dot"):
        rows = packing.pack(small_docs, max_docs=3, max_attention=300_000, rule=rule, group=64).collect()
        check_packing(rows, texts, tokenizer, max_docs=3, max_attention=300_000)


# ---- SimHash ----
def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    nodes = sorted(nodes)
    comp = {n: n for n in nodes}
    for n in nodes:
        if comp[n] != n:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            for y in nodes:
                if comp[y] > n and y != n and linked(x, y):
                    comp[y] = n
                    todo.append(y)
    return comp


def test_golay_keys_cover_one_and_two_bits():
    r = np.random.default_rng(1)
    w = r.integers(0, 1 << 23, 3000).astype(np.uint32)
    keys = [set(x.tolist()) for x in simhash.segment_keys(w, 23)]
    assert max(map(len, keys)) <= 6
    for a, b in ((3, 3), (7, 19), (0, 22)):
        other = w ^ np.uint32(1 << a)
        other = other if a == b else other ^ np.uint32(1 << b)
        assert all(k & set(x.tolist()) for k, x in zip(keys, simhash.segment_keys(other, 23)))


def test_simhash_equals_brute_force(spark, edge_docs, small_docs):
    for docs in (edge_docs, small_docs):
        rows = docs.collect()
        fp = {r.doc_id: brute_fingerprint(r.text) for r in rows if r.doc_id is not None}
        comp = brute_components(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 2)
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert (int(r.fingerprint, 16), r.component_id) == (fp[r.doc_id], comp[r.doc_id])
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


def test_links_of_dense_fingerprints(spark):
    """Many fingerprints close to one centre: blocks, large runs and long chains."""
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)}
    nodes = {i: f for i, f in enumerate(sorted(fps))}
    want = brute_components(nodes, lambda x, y: (nodes[x] ^ nodes[y]).bit_count() <= 2)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in nodes.items()], "fp long, node long")
    link = lambda c, i, j: np.bitwise_count(c["fp"][i] ^ c["fp"][j]) <= 2
    for block in (16, 2048):
        edges = graph.bucket_links(simhash.fuzzy_keys(df), ["kind", "exact", "near"], "node", ["fp"], link, block=block)
        got = {x.node: x.component_id for x in graph.components(edges).collect()}
        assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200, 2)] + [(i + 1, i + 2) for i in range(0, 200, 2)] + [(500, 501), (7, 7)]
    got = {r.node: r.component_id for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# ---- shards ----
def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    where = defaultdict(set)
    for r in rows:
        where[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_shards_are_atomic_and_minimax(spark, edge_docs, small_docs):
    for docs in (edge_docs, small_docs):
        rows = sharding.shard(docs, 24).collect()
        check_shards(rows, docs.collect(), 24)
    assert sharding.shard(edge_docs.limit(0), 24).count() == 0


def brute_minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        m, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > m:
                n, used = n + 1, 0
            used += s
        low, high = (low, m) if n <= shards else (m + 1, high)
    return low


def test_capacity_is_the_smallest(spark, small_docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BITS", 3)
    monkeypatch.setattr(sharding, "CANDIDATES", 5)
    rows = small_docs.selectExpr("xxhash64(text) k", "crc32(cast(text as binary)) text_crc32", "octet_length(text) + 8L size")
    groups = rows.groupBy("k", "text_crc32", "size").count().selectExpr("k", "text_crc32", "cast(size as long) size", "cast(size * count as long) bytes", "count n")
    sizes = [r.bytes for r in groups.orderBy("k", "text_crc32", "size").collect()]
    order = sharding._Order(groups)
    for shards in (2, 7, 24):
        assert sharding.smallest_capacity(order, shards, max(sizes)) == brute_minimax(sizes, shards)


def test_a_group_of_a_third_of_the_rows(spark, small_docs):
    hot = small_docs.limit(1).crossJoin(spark.range(90)).selectExpr("1000 + id as doc_id", "text")
    docs = small_docs.select("doc_id", "text").unionByName(hot)
    sizes = check_shards(sharding.shard(docs, 6).collect(), docs.collect(), 6)
    assert len(sizes) == 6
