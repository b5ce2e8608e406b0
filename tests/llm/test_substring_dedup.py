import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import substring_dedup as op


def brute_windows(v, run):
    out = []
    for c in range(len(v)):
        a = c
        while a > 0 and v[a - 1] > v[c]:
            a -= 1
        b = c
        while b + 1 < len(v) and v[b + 1] >= v[c]:
            b += 1
        if b - a + 1 >= run:
            out.append((a, c, b))
    return out


def test_compact_windows_equal_brute_force():
    r = random.Random(1)
    for n, top in ((5, 9), (40, 1000), (200, 8), (300, 10 ** 9)):
        for _ in range(20):
            texts = [[r.randint(1, top) for _ in range(r.randint(0, n))] for _ in range(3)]
            v = np.array(sum(texts, []), np.uint64)
            of = np.repeat(np.arange(3), [len(x) for x in texts])
            want, base = [], 0
            for x in texts:
                want += [(a + base, c + base, b + base) for a, c, b in brute_windows(x, 7)]
                base += len(x)
            assert list(zip(*(x.tolist() for x in op.compact_windows(v, of, 7)))) == want


def exact_passages(texts):
    """doc -> word places in 50-word windows that another document has too."""
    seen = defaultdict(set)
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - 49):
            seen[tuple(w[i:i + 50])].add((d, i))
    out = defaultdict(set)
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                out[d] |= set(range(i, i + 50))
    return out


def spans_of(row):
    return {i for s in row.spans.split(",") if s for i in range(*map(int, s.split(":")))}


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(4000)]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [fresh(60) for _ in range(4)]
    texts = {}
    for d in range(60):
        w = fresh(r.randint(60, 400))
        if d < 24:
            at = r.randint(0, len(w))
            w = w[:at] + passages[d % 4] + w[at:]
        texts[d] = " ".join(w)
    long = fresh(200)
    for d in range(60, 70):           # near copies: a word changed
        w = list(long)
        w[r.randint(0, 199)] = "changed%d" % d
        texts[d] = " ".join(w)
    line = fresh(8)                   # a common short line is no passage
    for d in range(70, 90):
        texts[d] = " ".join(fresh(100) + line + fresh(100))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = exact_passages(texts)
    got = {x.doc_id: x for x in op.near_duplicates(df).collect()}
    assert sorted(got) == sorted(texts)
    for d in texts:
        assert want[d] <= spans_of(got[d]), d
        if d < 24:
            assert got[d].component_id == d % 4
        elif d < 60 or d >= 70:
            assert got[d].n_spans == 0 and got[d].component_id == d and got[d].kept
        else:
            assert got[d].component_id == 60
        # at most the passage and the few words that may differ at its ends
        assert len(spans_of(got[d])) <= (80 if d < 24 else 200)


def test_whole_table_against_exact_windows(spark, small_docs):
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    want = exact_passages(texts)
    got = {x.doc_id: x for x in op.near_duplicates(small_docs).collect()}
    assert sorted(got) == sorted(texts)
    for d in texts:
        assert want[d] <= spans_of(got[d])
    shingles = {d: [tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)] for d, t in texts.items()}
    for d, row in got.items():          # whatever is reported shares 41 shingles with another document
        if row.n_spans:
            mine = [s for a in row.spans.split(",") for s in shingles[d][int(a.split(":")[0]):int(a.split(":")[1]) - 4]]
            others = [set(shingles[o]) for o in texts if o != d]
            assert max(sum(s in o for s in mine) for o in others) >= op.NEED - 3


@pytest.mark.parametrize("block", [2048, 8])
def test_edge_rows(spark, edge_docs, block, monkeypatch):
    monkeypatch.setattr(op.blocked, "__defaults__", (block,))
    rows = op.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert {by[d].component_id for d in (7, 8, 9, 11, -5)} == {-5}
    assert by[13].n_spans == 0 and by[18].n_spans == 0 and by[0].n_spans == 0
    assert all(r.component_id is None and not r.kept for r in rows if r.doc_id is None)
    assert op.near_duplicates(edge_docs.limit(0)).count() == 0


def test_contexts_that_share_a_run_agree_in_a_cover():
    r = np.random.default_rng(5)
    places = np.delete(np.arange(2 * op.REACH + 1), op.REACH)
    block_of = np.full(2 * op.REACH + 1, -1)
    block_of[places] = np.arange(len(places)) // op._BLOCK
    for _ in range(3000):
        start = r.integers(0, op.REACH + 1)                       # a run of RUN places around c
        same = np.zeros(2 * op.REACH + 1, bool)
        same[start:start + op.RUN] = True
        if r.random() < 0.5:                                      # five places that lie together
            gap = r.integers(start, start + op.RUN - 4)
            if gap <= op.REACH < gap + 5:
                continue
            same[gap:gap + 5] = False
        else:                                                     # five places at the two ends
            k = r.integers(0, 6)
            same[start:start + k] = same[start + op.RUN - 5 + k:start + op.RUN] = False
        if not same[op.REACH]:
            continue
        whole = {b for b in range(2 * op._SIDE) if same[block_of == b].all()}
        assert any(set(c) <= whole for c in op.COVERS)


def test_a_common_line_costs_no_comparisons_of_all_pairs(monkeypatch):
    r = np.random.default_rng(6)
    n = 3000
    codes = r.integers(1, op.CODES + 1, (n, 2 * op.REACH + 1)).astype(np.uint8)
    codes[:, op.REACH - 6:op.REACH + 16] = 3                      # 22 shingles that all texts share
    codes[1, :] = codes[0, :]
    compared, verify = [], op._verify
    monkeypatch.setattr(op, "_verify", lambda c, i, j: compared.append(len(i)) or verify(c, i, j))
    links = op._Links(codes, np.arange(n), np.zeros(n, np.int64))
    links.neighbours()
    links.rest()
    assert links.label[0] == links.label[1] and sum(compared) < 10 * n


def test_inserted_and_deleted_words_are_bridged(spark):
    r = random.Random(12)
    fresh = lambda n: ["v%d" % r.randrange(5000) for _ in range(n)]
    texts, pairs = {}, []
    for n in (52, 60, 80, 120, 400):
        for kind in ("insert", "delete"):
            for _ in range(8):
                one = fresh(n)
                at = range(40, n, 40) if n == 400 else [n // 2 + r.randint(-2, 2)]
                two = list(one)
                for k in reversed(at):
                    two[k:k + (kind == "delete")] = [] if kind == "delete" else ["inserted"]
                pairs.append((len(texts), n))
                for passage in (one, two):
                    texts[len(texts)] = " ".join(fresh(70) + passage + fresh(70))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in op.near_duplicates(df).collect()}
    linked = defaultdict(list)
    for d, n in pairs:
        assert got[d].component_id == d and got[d + 1].component_id in (d, d + 1)
        linked[n].append(got[d + 1].component_id == d)
        if linked[n][-1]:
            assert all(len(spans_of(got[x]) - set(range(70, 72 + n))) <= 14 for x in (d, d + 1))
    assert all(sum(x) >= 15 for x in linked.values()), {n: sum(x) for n, x in linked.items()}


def test_sketches_bring_inserted_words_together_in_large_buckets():
    r = np.random.default_rng(7)
    n = 400
    codes = r.integers(1, op.CODES + 1, (n, 2 * op.REACH + 1)).astype(np.uint8)
    for k in range(0, n, 2):                                      # an insertion 12 places after c
        gap = op.REACH + 12
        codes[k + 1, op.REACH - 20:gap] = codes[k, op.REACH - 20:gap]
        codes[k + 1, gap + 5:] = codes[k, gap + 4:-1]
    links = op._Links(codes, np.arange(n), np.zeros(n, np.int64))
    links.neighbours()
    links.rest()
    assert (links.label[0::2] == links.label[1::2]).mean() > 0.97


def test_repeats_inside_a_document_are_reported_at_every_place(spark):
    r = random.Random(21)
    fresh = lambda n: ["u%d" % r.randrange(5000) for _ in range(n)]
    line, passage = fresh(10), fresh(200)
    texts = {0: line * 300, 1: line * 300, 2: fresh(40) + passage + fresh(60) + passage + fresh(30), 3: fresh(50) + passage,
             4: fresh(30) + line * 12 + fresh(30), 5: fresh(300)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x for x in op.near_duplicates(df).collect()}
    want = exact_passages({d: " ".join(w) for d, w in texts.items()})
    for d in (0, 1, 3, 4, 5):
        assert want[d] <= spans_of(got[d]), (d, got[d].spans)
    assert {*range(45, 235), *range(305, 495)} <= spans_of(got[2])
    assert got[0].n_repeated_words == 3000 and got[5].n_spans == 0
    assert {got[d].component_id for d in (0, 1, 4)} == {0} and got[3].component_id == 2


def test_islands_join_what_touches():
    r = np.random.default_rng(3)
    for _ in range(50):
        doc, start = r.integers(-3, 3, 30), r.integers(0, 200, 30)
        end = start + r.integers(1, 20, 30)
        got = op._islands(doc, start, end)
        for d in range(-3, 3):
            cover = lambda rows: {x for a, b in rows for x in range(a, b)}
            own = [(a, b) for k, a, b in got.tolist() if k == d]
            assert cover(own) == cover((a, b) for k, a, b in zip(doc, start, end) if k == d)
            assert all(x[1] < y[0] for x, y in zip(own, own[1:]))


def test_connected_rows_have_their_widest_runs(spark):
    r = random.Random(33)
    fresh = lambda n: ["s%d" % r.randrange(5000) for _ in range(n)]
    texts, common = {}, fresh(60)
    for k in range(40):                   # all share 60 words, pairs of documents 14 more on a side
        more = fresh(14)
        for _ in range(2):
            own = more + common if k % 2 else common + more
            texts[len(texts)] = fresh(60) + own + fresh(60)
    for _ in range(20):                   # twice in one document
        passage = fresh(200)
        texts[len(texts)] = fresh(40) + passage + fresh(60) + passage + fresh(30)
        texts[len(texts)] = fresh(50) + passage
    order = list(texts)
    r.shuffle(order)                      # pairs are not next to each other in any other order
    df = spark.createDataFrame([(order[d], " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    want = exact_passages({order[d]: " ".join(w) for d, w in texts.items()})
    got = {x.doc_id: x for x in op.near_duplicates(df).collect()}
    lost = {d: len(want[d] - spans_of(got[d])) for d in got}
    assert sum(x > 0 for x in lost.values()) == 0, lost


def test_every_row_of_a_connected_bucket_gets_the_longest_half():
    r = np.random.default_rng(11)
    n = 200
    codes = r.integers(1, op.CODES + 1, (n, 2 * op.REACH + 1)).astype(np.uint8)
    codes[:, op.REACH - 25:op.REACH + 24] = codes[0, op.REACH - 25:op.REACH + 24]
    for k in range(0, n, 2):              # pairs share more on the right
        codes[k + 1, op.REACH:op.REACH + 40] = codes[k, op.REACH:op.REACH + 40]
    links = op._Links(codes, np.arange(n) // 4 * 2 + np.arange(n) % 2, np.zeros(n, np.int64))
    links.neighbours()
    links.rest()
    links.widest()
    assert (links.hi >= op.REACH + 39).all() and (links.lo <= op.REACH - 25).all() and len(np.unique(links.label)) == 1


def inserted_pairs(r, n):
    codes = r.integers(1, op.CODES + 1, (n, 2 * op.REACH + 1)).astype(np.uint8)
    for k in range(0, n, 2):                                      # an insertion, 15 to 24 places after c or before it
        gap, side = 15 + k // 2 % 10, k // 2 % 2
        one, two = (codes[k, ::-1], codes[k + 1, ::-1]) if side else (codes[k], codes[k + 1])
        two[op.REACH - 22:op.REACH + gap] = one[op.REACH - 22:op.REACH + gap]
        two[op.REACH + gap + 5:] = one[op.REACH + gap + 4:-1]
    return codes


def linked(codes, group):
    links = op._Links(codes, np.arange(len(codes)), group)
    links.neighbours()
    links.rest()
    links.widest()
    return links


def test_links_and_runs_do_not_depend_on_the_size_of_the_bucket():
    n = 1200
    codes = inserted_pairs(np.random.default_rng(17), n)
    alone, together = linked(codes, np.arange(n) // 2), linked(codes, np.zeros(n, np.int64))
    assert (alone.label[0::2] == alone.label[1::2]).all()
    assert (together.label == alone.label).all()
    assert (together.lo == alone.lo).all() and (together.hi == alone.hi).all()


def test_links_and_runs_do_not_depend_on_the_other_buckets_of_the_task():
    r = np.random.default_rng(18)
    n = 60
    codes = inserted_pairs(r, n)
    for k in range(4, n, 4):                                      # groups whose members are connected by a few pairs
        codes[k:k + 2, :op.REACH + 10] = codes[k - 4, :op.REACH + 10]
    more = np.repeat(inserted_pairs(r, 300), 3, axis=0)
    alone = linked(codes, np.zeros(n, np.int64))
    both = linked(np.concatenate([codes, more]), np.repeat([0, 1], [n, len(more)]))
    assert (both.label[:n] == alone.label).all()
    assert (both.lo[:n] == alone.lo).all() and (both.hi[:n] == alone.hi).all()


def test_no_similar_pair_of_a_bucket_is_left_apart():
    r = np.random.default_rng(19)
    n = 240
    codes = inserted_pairs(r, n)
    codes[100:180, op.REACH - 9:op.REACH + 20] = codes[0, op.REACH - 9:op.REACH + 20]
    codes[r.integers(0, n, 60), :20] = 0
    links = linked(codes, np.zeros(n, np.int64))
    i, j = np.triu_indices(n, 1)
    ok = op._verify((links.codes, links.planes), i, j)[0]
    assert ok.sum() > n // 3 and (links.label[i[ok]] == links.label[j[ok]]).all()


def test_pairs_with_the_same_contexts_are_looked_at_once(monkeypatch):
    r = np.random.default_rng(23)
    n = 300
    codes = r.integers(1, op.CODES + 1, (6, 2 * op.REACH + 1)).astype(np.uint8)
    codes[:, op.REACH - 17:op.REACH + 18] = codes[0, op.REACH - 17:op.REACH + 18]       # alike, but no passage
    codes[3:, op.REACH:] = codes[3, op.REACH:]
    codes = codes[r.integers(0, 6, n)]
    i, j = np.triu_indices(n, 1)
    verify, looked = op._verify, []
    ok, *ends = verify((codes, op._planes(codes)), i, j)
    monkeypatch.setattr(op, "_verify", lambda c, i, j: looked.append(len(i)) or verify(c, i, j))
    links = op._Links(codes, np.arange(n), np.zeros(n, np.int64))
    links.compare(i, j)
    assert sum(looked) <= 36
    lo, hi = np.full(n, 1 << 30), np.full(n, -1)
    for rows, first, last in ((i, *ends[:2]), (j, *ends[2:])):
        np.minimum.at(lo, rows[ok], first[ok])
        np.maximum.at(hi, rows[ok], last[ok])
    assert ok.any() and not ok.all() and (links.lo == lo).all() and (links.hi == hi).all()
    assert len(links.left[0]) == ok.sum()


def test_pairs_dropped_after_the_alignment_are_no_passages(monkeypatch):
    r = np.random.default_rng(29)
    n = 4000
    one = r.integers(1, op.CODES + 1, (n, 2 * op.REACH + 1)).astype(np.uint8)
    two = one.copy()
    for k in range(n):                                            # left out, inserted and changed places
        for _ in range(r.integers(1, 5)):
            at, by = r.integers(op.REACH + 1, 2 * op.REACH - 6), r.integers(1, 7)
            side = two[k] if r.random() < 0.5 else two[k, ::-1]
            kind = r.integers(0, 3)
            if kind == 0:
                side[at:-by] = side[at + by:].copy()
            elif kind == 1:
                side[at + by:] = side[at:-by].copy()
            else:
                side[at:at + by] = r.integers(1, op.CODES + 1, by)
    planes = [op._planes(x) for x in (one, two)]
    got, shifted = op._bridged(*planes), op._shifted
    monkeypatch.setattr(op, "_shifted", lambda runs_at, least: shifted(runs_at, 0))
    want = op._bridged(*planes)
    assert 0 < len(want[0]) < n and all(np.array_equal(x, y) for x, y in zip(got, want))


def test_rows_with_equal_contexts_are_compared_as_one(monkeypatch):
    r = np.random.default_rng(29)
    n, times = 120, 12
    codes = inserted_pairs(r, n)
    codes[:, op.REACH - 14:op.REACH + 12] = codes[0, op.REACH - 14:op.REACH + 12]      # alike, so that many meet
    compare, looked = op._Links.compare, []
    monkeypatch.setattr(op._Links, "compare", lambda self, i, j: looked.append(len(i)) or compare(self, i, j))
    one = linked(codes, np.zeros(n, np.int64))
    alone, looked[:] = sum(looked), []
    links = linked(np.repeat(codes, times, axis=0), np.zeros(n * times, np.int64))
    # before, pairs of rows: times * times as many, about
    assert sum(looked) <= 2 * alone + n
    assert (links.lo == 0).all() and (links.hi == 2 * op.REACH).all()
    assert (links.label.reshape(n, times) == times * one.label[:, None]).all()


def test_blocks_of_a_large_bucket_leave_nothing_apart():
    r = np.random.default_rng(31)
    n, blocks = 360, 3
    codes = inserted_pairs(r, n)
    codes[60:120] = codes[:60]                                    # equal ones, also of one document
    codes[120:150] = codes[:30]
    doc = np.arange(n)
    doc[300:] = doc[:60]
    order = np.lexsort(codes.T)
    codes, doc = codes[order], doc[order]
    whole = op._Links(codes, doc, np.zeros(n, np.int64))
    for step in (whole.neighbours, whole.rest, whole.widest):
        step()
    block = doc * 7 % blocks
    left, right, lo, hi = [], [], np.full(n, 1 << 30), np.full(n, -1)
    for p in range(blocks):
        for q in range(p, blocks):
            rows = np.flatnonzero((block == p) | (block == q))
            own = -1 - len(rows) - np.arange(len(rows))
            links = op._Links(codes[rows], doc[rows], np.zeros(len(rows), np.int64), own if p == q else block[rows])
            for step in (links.neighbours, links.rest, links.widest):
                step()
            left.append(rows[np.concatenate(links.left)])
            right.append(rows[np.concatenate(links.right)])
            np.minimum.at(lo, rows, links.lo)
            np.maximum.at(hi, rows, links.hi)
    label = op.joined(whole.label, np.concatenate(left), np.concatenate(right))
    parts = op.joined(np.unique(doc, return_index=True)[1][np.unique(doc, return_inverse=True)[1]], np.concatenate(left), np.concatenate(right))
    assert (label == whole.label).all() and len(np.unique(parts)) == len(np.unique(whole.label))
    assert ((hi >= 0) == (whole.hi >= 0)).all() and (lo <= whole.lo).all() and (hi >= whole.hi).all()


def test_a_large_bucket_is_not_repeated_by_many_blocks(spark):
    """Rows of a bucket are sent once for each block: 20,000 of them to a few tasks."""
    rows = spark.range(20_000).selectExpr("1L as key", "id as doc")
    assert op.blocked(rows, ["key"], "doc", op.BLOCK).count() <= 2 * 20_000
