"""Substring near-duplicates by compact windows of min-hashes.

A text is its sequence of five-word shingles.  Under a hash function, every run of shingles has a
min-hash; the Cartesian tree over the hashes groups all runs with their minimum at the same place c
into one compact window (a, c, b): the runs that begin in a..c and end in c..b.  Only windows wide
enough for a passage of LEAST_WORDS words matter, and their centres are the minima of sliding
windows, so the tree is built over those few places alone.

Windows of different documents with the same min-hash meet in a bucket.  Two of them are joined on
their intervals: aligned at c, only the shingles inside both (a..b) can match, and a passage pair is
a near-duplicate when some run of a passage's length around c has a Jaccard similarity of at least
SIMILARITY; where words are inserted or left out, the alignment goes on shifted (SHIFT words at most).  Each of HASHES functions is another chance to meet; a pair at the threshold is lost with
a chance of (1 - SIMILARITY) ** HASHES for each passage's length that it shares.

Buckets are compared in blocks, without emitting pairs: tasks return a spanning forest, and for each
window the widest run that it was seen to share.  Rows of different documents with equal contexts are
linked as one pair of them is, and then stand as one row.  First, rows that agree in a piece of their
contexts are compared with their neighbours in the order of contexts, which connects most of a bucket.  Where
a bucket is not connected by that, or a row has no run yet, the rows that have enough pieces of five
shingles in common are compared until they are connected, wherever these pieces lie (words may be
inserted) and whatever the bucket's size.  At last each row is compared with
those that share most with it on either side of c, so connected rows have their widest runs too.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import textnum as tn
from .graph import blocked, components, forest, joined, run_starts, runs

LEAST_WORDS = 50
SHINGLE = 5
SIMILARITY = 0.8
HASHES = 3
RUN = LEAST_WORDS - SHINGLE + 1                    # shingles of the shortest passage
REACH = RUN - 1                                    # how far from c such a run can lie
#: pieces of a context, three on either side of c.  A run of a passage's length has 23 places or more
#: on one side; at most 5 of its places differ, and they lie together (a changed word changes the five
#: shingles that hold it), so two such contexts agree in one of the pieces
PIECES = [np.arange(REACH + s, REACH + s + 7) for s in (1, 8, 15, -7, -14, -21)]
#: matches that a run needs: m / (2 * RUN - m) >= SIMILARITY
NEED = int(np.ceil(2 * RUN * SIMILARITY / (1 + SIMILARITY) - 1e-9))
CODES = 15                                         # values of a shingle in a window's row; 0: outside
SHIFT = 12                                         # words that one side may have more than the other
#: places of a run that must match next to each other where the alignment is shifted
LEAST_RUN = 5
#: lengths of the runs whose Jaccard similarity is looked at
LENGTHS = (RUN - 1, RUN, 52, 60, 70, 80, 2 * REACH + 1)
LEAST_PIECES = NEED - 12                           # pieces of five places that a similar run has in three parts
TOGETHER = 1 << 18                                 # pairs that are looked at at a time, about
TASK_ROWS = 1 << 15                                # rows that a task compares, about
BLOCK = 1 << 14                                    # rows of a block: a larger bucket is compared by pairs of blocks

_CTX_BYTES = REACH + 1                             # of a row's context: two codes a byte

_BLOCK = 5                                         # places of a block of the context; c is in none
_SIDE = REACH // _BLOCK                            # blocks on either side of c


def _covers() -> list[list[int]]:
    """Sets of blocks, one of which two contexts agree in when they share a run.

    The run reaches over 45 places beside c, so over eight whole blocks at least, next to each other.
    Its places that differ lie together (at most five, so in two blocks that touch) or at its two
    ends (41 places agree in one piece: seven blocks or more).  Either way six blocks are left of
    eight when two that touch are left out; blocks on both sides of c need not go together, as c
    itself agrees."""
    out = set()
    for left in range(9):
        eight = range(_SIDE - left, _SIDE - left + 8)
        for p in range(7):
            if p == 0 or p == 6 or p != left - 1:
                out.add(tuple(b for k, b in enumerate(eight) if k not in (p, p + 1)))
    return [list(c) for c in sorted(out)]


COVERS = _covers()


def _sliding(v: np.ndarray, width: int, op, pad) -> np.ndarray:
    """op over v[i : i + width] for every i; beyond the end counts as ``pad``."""
    out, have = v, 1
    while have * 2 <= width:
        out = op(out, np.concatenate([out[have:], np.full(min(have, len(out)), pad, v.dtype)])[:len(out)])
        have *= 2
    if width > have:
        d = width - have
        out = op(out, np.concatenate([out[d:], np.full(min(d, len(out)), pad, v.dtype)])[:len(out)])
    return out


def compact_windows(v: np.ndarray, text: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, b) of all compact windows with b - a + 1 >= run over the values of several texts
    (``text``: rising numbers); of equal values the leftmost is the minimum."""
    n = len(v)
    none = np.zeros(0, np.int64)
    if n < run:
        return none, none, none
    inside = np.zeros(n, bool)
    inside[:n - run + 1] = text[:n - run + 1] == text[run - 1:]
    low = _sliding(v, run, np.minimum, np.iinfo(v.dtype).max)
    low = np.where(inside, low, 0)
    # c is a minimum of some run: the largest of the minima of the runs that hold it is its own
    high = _sliding(low[::-1], run, np.maximum, 0)[::-1]
    c = np.flatnonzero((high == v) & (v > 0))
    if not len(c):
        return none, none, none
    # the tree's parents are the nearest smaller values on either side; a zero stands between texts
    starts = run_starts([text[c]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
    at = np.arange(len(c)) + of + 1
    x, low = v[c], [np.zeros(len(c) + len(starts) + 1, v.dtype)]
    low[0][at] = x
    while 1 << len(low) <= np.diff(np.append(starts, len(c))).max():
        k = 1 << len(low) - 1
        low.append(np.minimum(low[-1][:-k], low[-1][k:]))
    before, after = at.copy(), at + 1
    for k in range(len(low) - 1, -1, -1):
        p = before - (1 << k)
        before = np.where((p >= 0) & (low[k][np.maximum(p, 0)] > x), p, before)
        after = np.where((after < len(low[k])) & (low[k][np.minimum(after, len(low[k]) - 1)] >= x), after + (1 << k), after)
    # places of the texts' ends, and of the centres
    edge = np.searchsorted(text, text[c[starts]])
    place = np.empty(len(low[0]), np.int64)
    place[at], place[at[starts] - 1] = c, edge - 1
    a = place[before - 1] + 1
    place[at[np.append(starts[1:], len(c)) - 1] + 1] = np.searchsorted(text, text[c[starts]], "right")
    b = place[after] - 1
    wide = b - a + 1 >= run
    return a[wide], c[wide], b[wide]


def _windows(t: tn.Texts, contexts: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """For each hash function: (text, place, key) of the windows of ``t``, or (text, places, their
    offsets, key, context); a window that a text repeats with the same context is given once, with
    all its places."""
    starts, ends, words = tn.word_spans(t)
    h = tn.windows(tn.SpanHash(t.buf)(starts, ends), SHINGLE)
    text = np.repeat(np.arange(t.n), words)
    whole = text[:len(h)] == text[SHINGLE - 1:SHINGLE - 1 + len(h)]
    first_word = np.concatenate([[0], np.cumsum(words)])[:-1]
    h, place, text = h[whole], (np.arange(len(h)) - first_word[text[:len(h)]])[whole], text[:len(h)][whole]
    if not len(h):
        return
    code = (tn.mix64(h ^ np.uint64(0xC0DE)) % np.uint64(CODES)).astype(np.uint8) + 1
    around = np.lib.stride_tricks.sliding_window_view(np.pad(code, REACH), 2 * REACH + 1)
    for k in range(HASHES):
        v = tn.mix64(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        a, c, b = compact_windows(v, text)
        if not len(c):
            continue
        if not contexts:
            yield text[c], place[c], v[c].view(np.int64)
            continue
        off = np.arange(-REACH, REACH + 1, dtype=np.int8)
        seen = off >= np.maximum(a - c, -REACH).astype(np.int8)[:, None]
        seen &= off <= np.minimum(b - c, REACH).astype(np.int8)[:, None]
        codes = np.zeros((len(c), 2 * _CTX_BYTES), np.uint8)
        codes[:, :2 * REACH + 1] = around[c] * seen
        ctx = codes[:, 0::2] << 4 | codes[:, 1::2]
        mark = np.zeros((len(c), -(-ctx.shape[1] // 8) * 8), np.uint8)
        mark[:, :ctx.shape[1]] = ctx
        one = (mark.view(np.uint64) * tn.mix64(np.arange(1, mark.shape[1] // 8 + 1, dtype=np.uint64))).sum(1, dtype=np.uint64)
        _, once, same = np.unique(tn.mix64(one ^ v[c]) ^ tn.mix64(text[c].astype(np.uint64) + np.uint64(7)), return_index=True, return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(same))])
        yield text[c][once], place[c][np.argsort(same, kind="stable")], offsets, v[c][once].view(np.int64), ctx[once]


def _emit(docs: DataFrame, contexts: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = rb.column(0).to_numpy()
            for t in tn.chunks(rb.column(1)):
                for found in _windows(t, contexts):
                    doc = ids[t.lo + found[0]]
                    out = {"key": pa.array(found[3 if contexts else 2]), "doc": pa.array(doc, pa.int64())}
                    if contexts:
                        width = found[4].shape[1]
                        out["places"] = pa.ListArray.from_arrays(pa.array(found[2], pa.int32()), pa.array(found[1], pa.int32()))
                        out["ctx"] = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(doc), [None, pa.py_buffer(found[4].tobytes())]).cast(pa.binary())
                    yield pa.record_batch(out)

    return docs.mapInArrow(work, "key long, doc long" + (", places array<int>, ctx binary" if contexts else ""))


def _codes(ctx: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(ctx.to_pylist()), np.uint8).reshape(-1, _CTX_BYTES)
    out = np.empty((len(raw), 2 * _CTX_BYTES), np.uint8)
    np.right_shift(raw, 4, out=out[:, 0::2])
    np.bitwise_and(raw, 15, out=out[:, 1::2])
    return out[:, :2 * REACH + 1]


def _parts(group: np.ndarray, rows: np.ndarray, codes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` with no place outside in ``codes`` (theirs, the places to agree in; ``blocks``: hash
    of these), those of a group with equal hashes side by side, and the number of each one's part."""
    whole = (codes > 0).all(1)
    rows, mark = rows[whole], tn.mix64(blocks[whole] ^ tn.mix64(group[rows[whole]].astype(np.uint64)))
    order = np.argsort(mark, kind="stable")
    rows, mark = rows[order], mark[order]
    return rows, np.cumsum(np.concatenate([[0], mark[1:] != mark[:-1]]))[:len(rows)]


def _hashes(codes: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of codes."""
    weight = tn.mix64(np.arange(1, codes.shape[1] + 1, dtype=np.uint64) + np.uint64(seed << 20))
    return tn.mix64((codes * weight).sum(1, dtype=np.uint64))


class _Links:
    """Links between the rows of a task's buckets, found by comparing some of their pairs."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, group: np.ndarray, block: np.ndarray | None = None):
        """``block``: rows with equal ones are compared by another task."""
        self.codes, self.doc, self.group, n = codes, doc, group, len(doc)
        self.block = np.arange(n) if block is None else block
        self.planes = _planes(codes)
        # rows with equal contexts have a number in common
        self.alike = np.unique(_hashes(codes, len(PIECES)), return_inverse=True)[1]
        self.lo, self.hi = np.full(n, 1 << 30, np.int64), np.full(n, -1, np.int64)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        # a document's rows in one bucket are one node
        _, first, inverse = np.unique(np.stack([group, doc], 1), axis=0, return_index=True, return_inverse=True)
        self.label = joined(np.arange(n), np.arange(n), first[inverse.ravel()])
        # the rows that are compared, and a number for their documents
        self.rows, self.who = np.arange(n), np.unique(doc, return_inverse=True)[1]

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """i < j: a shifted alignment goes from the first row to the other.  Of pairs with the same two
        contexts, one is looked at for all."""
        _, one, of = np.unique(self.alike[i] * len(self.doc) + self.alike[j], return_index=True, return_inverse=True)
        ok, *spans = _verify((self.codes, self.planes), i[one], j[one])
        hit = np.flatnonzero(ok[of])
        i, j, of = i[hit], j[hit], of[hit]
        for r, start, stop in ((i, *spans[:2]), (j, *spans[2:])):
            np.minimum.at(self.lo, r, start[of])
            np.maximum.at(self.hi, r, stop[of])
        self.left.append(i)
        self.right.append(j)
        self.label = joined(self.label, i, j)

    def equal(self) -> None:
        """Rows of a bucket with equal contexts, of two documents or more: one pair is compared for all.
        If it is similar, all are linked and have its run, which is as wide as their context; from here
        on one of them stands for all, as a document and a block of its own."""
        order, n = np.lexsort((self.doc, self.alike, self.group)), len(self.doc)
        starts = run_starts([self.group[order], self.alike[order]])
        size = np.diff(np.append(starts, n))
        first, last = order[starts], order[starts + size - 1]
        some = self.doc[first] != self.doc[last]
        self.compare(np.minimum(first, last)[some], np.maximum(first, last)[some])
        some &= self.hi[first] >= 0
        one, all_of = np.repeat(first[some], size[some]), order[np.repeat(some, size)]
        self.lo[all_of], self.hi[all_of] = self.lo[one], self.hi[one]
        kept = np.ones(n, bool)
        kept[all_of] = one == all_of
        self.left.append(all_of[one != all_of])
        self.right.append(one[one != all_of])
        self.label = joined(self.label, self.left[-1], self.right[-1])
        self.rows, self.block = np.flatnonzero(kept), self.block.copy()
        self.who[first[some]], self.block[first[some]] = n + first[some], -1 - first[some]

    def neighbours(self) -> None:
        """Rows that agree in a piece, each with the next one in the order of contexts."""
        self.equal()
        n, pairs, codes = len(self.doc), [], self.codes[self.rows]
        for k, piece in enumerate(PIECES):
            part = codes[:, piece]
            rows, of = _parts(self.group, self.rows, part, _hashes(part, k))
            i, j = _beside(rows, of, self.who[rows])[:2]
            pairs.append(np.minimum(i, j) * n + np.maximum(i, j))
        pairs = np.unique(np.concatenate(pairs))
        self.compare(pairs // n, pairs % n)

    def rest(self) -> None:
        """In buckets that are not connected, or have a row without a run: the pairs that may share one
        (see _alike), of rows that nothing connects yet or of which one has no run.  Near rows come first;
        each round leaves out what the rounds before have connected.  What is compared depends on the
        bucket's own rows alone, not on their number or on the other buckets of the task."""
        starts = run_starts([self.group])
        size = np.diff(np.append(starts, len(self.group)))
        mixed = np.minimum.reduceat(self.label, starts) != np.maximum.reduceat(self.label, starts)
        mixed |= np.logical_or.reduceat(self.hi < 0, starts)
        rows = self.rows[np.repeat(mixed, size)[self.rows]]
        row, token = _alike(self.codes[rows], self.group[rows])
        row, n, far = rows[row], len(self.doc), 1
        # all pairs of a row together, so that none is compared twice
        by_row = np.argsort(row, kind="stable")
        while len(row):
            # what is alike in rows that are done needs no look
            first = run_starts([token])
            size = np.diff(np.append(first, len(row)))
            label, bare = self.label.copy(), self.hi < 0
            todo = np.minimum.reduceat(label[row], first) != np.maximum.reduceat(label[row], first)
            todo = np.repeat((todo | np.logical_or.reduceat(bare[row], first)) & (row[first + size - 1] - row[first] >= far), size)
            by_row = (np.cumsum(todo) - 1)[by_row[todo[by_row]]]
            row, of = row[todo], np.repeat(np.arange(len(size)), size)[todo]
            token = token[todo]
            if not len(row):
                break
            # rows without a run are no part of any other's
            part_of = np.where(bare, n + np.arange(n), label)[row].astype(np.int32)
            at = of * n + row
            low = np.searchsorted(at, np.minimum(at + far, (of + 1) * n))
            many = np.searchsorted(at, np.minimum(at + 2 * far, (of + 1) * n)) - low
            ends = np.cumsum(many[by_row])
            new = np.append(run_starts([row[by_row]]), len(row))
            k = 0
            while k < len(new) - 1:
                done = ends[new[k] - 1] if k else 0
                stop = max(k + 1, int(np.searchsorted(ends[new[1:] - 1], done + TOGETHER, "right")))
                part = by_row[new[k]:new[stop]]
                k = stop
                count = many[part]
                if not count.any():
                    continue
                at_j = np.arange(count.sum()) + np.repeat(low[part] - np.cumsum(count) + count, count)
                near = np.flatnonzero(part_of[at_j] != np.repeat(part_of[part], count))
                i, j = row[np.repeat(part, count)[near]], row[at_j[near]]
                near = (self.who[i] != self.who[j]) & (self.block[i] != self.block[j])
                pairs = np.unique(i[near] * n + j[near])
                self.compare(pairs // n, pairs % n)
            far *= 2

    def widest(self) -> None:
        """Each row with the rows that share most with it outwards from c, to the right and to the
        left: its neighbours of other documents in the order of such halves.  So also rows that are
        connected already get their widest run."""
        starts = run_starts([self.group])
        size = np.diff(np.append(starts, len(self.group)))
        rows = self.rows[np.repeat(size > 2, size)[self.rows]]  # two have been compared
        for half in (self.codes[rows, REACH + 1:], self.codes[rows, REACH - 1::-1]):
            words = [np.zeros(len(rows), np.uint64) for _ in range(3)]
            for k in range(REACH):
                words[k // 15] = words[k // 15] << np.uint64(4) | half[:, k]
            order = np.lexsort((*words[::-1], self.group[rows]))
            at = rows[order]
            i, j, x, y = _beside(at, self.group[at], self.who[at])
            i, j = np.concatenate([i, x]), np.concatenate([j, y])
            pairs = np.unique(np.minimum(i, j) * len(self.doc) + np.maximum(i, j))
            self.compare(pairs // len(self.doc), pairs % len(self.doc))


def _beside(rows: np.ndarray, of: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, next row of another document) and (last row of another document before, row) of the
    rows of each part (``of``: equal ones side by side)."""
    if not len(rows):
        return rows, rows, rows, rows
    starts = run_starts([of, doc])
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    after, before = np.append(starts[1:], len(rows))[number], starts[number] - 1
    i, x = np.flatnonzero(after < len(rows)), np.flatnonzero(before >= 0)
    i, x = i[of[i] == of[after[i]]], x[of[x] == of[before[x]]]
    return rows[i], rows[after[i]], rows[before[x]], rows[x]


def _pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of five places of each context, and whether they have no place outside."""
    n = codes.shape[1] - 4
    piece, inside = np.zeros((len(codes), n), np.uint64), np.ones((len(codes), n), bool)
    for k in range(5):
        piece = piece << np.uint64(4) | codes[:, k:k + n]
        inside &= codes[:, k:k + n] > 0
    return piece, inside


def _alike(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token), by token and row: rows that may share a similar run have a token in common.

    A similar run has NEED places in three parts at most, so two such rows share LEAST_PIECES pieces
    or more, wherever these lie (a piece that a row repeats counts as often as both have it).  Then they
    share one of those that are left of either row without its LEAST_PIECES - 1 commonest pieces: what
    many texts of a bucket have in common, like a line, brings no rows together unless it is that long."""
    piece, inside = _pieces(codes)
    have = inside.sum(1)
    rows = np.flatnonzero(have >= LEAST_PIECES)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = piece.shape[1]
    piece = np.sort(np.where(inside[rows], piece[rows], np.uint64(1 << 20)), axis=1)
    place = np.arange(width, dtype=np.int16)
    new = np.ones(piece.shape, bool)
    new[:, 1:] = piece[:, 1:] != piece[:, :-1]
    again = place - np.maximum.accumulate(np.where(new, place, np.int16(0)), axis=1)
    number = np.cumsum(np.concatenate([[0], group[rows][1:] != group[rows][:-1]])).astype(np.uint64)
    token = number[:, None] << np.uint64(27) | again.astype(np.uint64) << np.uint64(20) | piece
    # how common a token is, at least: any order of the tokens will do, if it is the same for all rows
    mark = (token * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
    often = np.bincount(mark[piece < np.uint64(1 << 20)], minlength=1 << 22)[mark]
    often[piece == np.uint64(1 << 20)] = 0
    # those of this row alone are the rarest ones
    left = have[rows] - LEAST_PIECES + 1 - (often == 1).sum(1)
    row, place = np.nonzero((often > 1) & (left > 0)[:, None])
    often, token = often[row, place], token[row, place]
    order = np.lexsort((token, often, row))
    row, token = row[order], token[order]
    starts = run_starts([row]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    taken = rank < left[row]
    row, token = rows[row[taken]], token[taken]
    # of tokens that the same rows have, one will do
    order = np.lexsort((row, token))
    row, token = row[order], token[order]
    starts = run_starts([token]) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(row)))
    who = np.add.reduceat(tn.mix64(row.astype(np.uint64)), starts) if len(row) else np.zeros(0, np.uint64)
    once = np.zeros(len(starts), bool)
    once[np.unique(who, return_index=True)[1]] = True
    kept = np.repeat(once & (size > 1), size)
    return row[kept], np.cumsum(np.repeat(once, size) & np.isin(np.arange(len(row)), starts))[kept]


def _planes(codes: np.ndarray) -> np.ndarray:
    """Each row's places as bits of 64-bit words, outwards from c (c first) to the left and to the right:
    a word for each bit of the codes, and one for the places that are not outside."""
    out = np.empty((2, len(codes), 5), np.uint64)
    for side, half in zip(out, (codes[:, REACH::-1], codes[:, REACH:])):
        wide = np.zeros((len(codes), 64), np.uint8)
        wide[:, :REACH + 1] = half
        for k in range(4):
            side[:, k] = np.packbits(wide >> k & 1, axis=1, bitorder="little").view(np.uint64).ravel()
        side[:, 4] = np.packbits(wide > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _same(a, b) -> np.ndarray:
    """Bits of the places that match, of the five words of two rows."""
    return ~((a[0] ^ b[0]) | (a[1] ^ b[1]) | (a[2] ^ b[2]) | (a[3] ^ b[3])) & a[4] & b[4]


def _ones(x: np.ndarray) -> np.ndarray:
    """How many of the lowest bits are set without a gap."""
    return np.bitwise_count(x & ~(x + np.uint64(1))).astype(np.int64)


SHIFTS = np.array(sorted(range(-SHIFT, SHIFT + 1), key=abs))[:, None]


def _runs_at(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of the places of ``a`` that match for each of the SHIFTS of ``b``: those that are part of
    LEAST_RUN places that match side by side, and for none c itself and what matches beside it."""
    out = np.empty((len(SHIFTS) + 1, len(a)), np.uint64)
    match, other, one = out[1:], np.empty((len(SHIFTS), len(a)), np.uint64), np.uint64(1)
    match[:] = 0
    by = np.arange(SHIFT + 1, dtype=np.uint64)[:, None]
    for x, y in zip(a.T[:4], b.T[:4]):
        # as the SHIFTS lie: none, then in and out in turn
        np.right_shift(y, by, out=other[0::2])
        np.left_shift(y, by[1:], out=other[1::2])
        other ^= x
        match |= other
    # what equals a place that is not outside is not outside
    np.invert(match, out=match)
    match &= a[:, 4]
    near = match[0] & np.uint64((1 << LEAST_RUN) - 1)
    for shift, join in ((np.right_shift, np.bitwise_and), (np.left_shift, np.bitwise_or)):
        have = 1
        while have < LEAST_RUN:
            step = min(have, LEAST_RUN - have)
            join(match, shift(match, np.uint64(step), out=other), out=match)
            have += step
    # c goes first: what lies beside it counts for the unshifted alignment only
    np.bitwise_or(match[0], near & ~(near + one), out=out[0])
    return out


def _shifted(runs_at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the _runs_at of two rows, first the left sides and then the right ones: the pairs with
    ``least`` matches; for both of their sides, whether each place of the first row has a match in the
    other, both in rising order, and by how many places it lies farther out there.  Where a match ends,
    the longest that follows is taken."""
    n, width, one = runs_at.shape[1], REACH + 1, np.uint64(1)
    current, runs_at = runs_at[0], runs_at[1:]
    bits, turns = np.ones(n, np.uint64), []
    now, last, p, rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), np.arange(n)
    while len(rows):
        # to the end of the match that goes on at p
        at = p.astype(np.uint64)
        more = _ones(current >> at)
        bits[rows] |= ((one << more.astype(np.uint64)) - one) << at
        last = np.where(more > 0, p + more - 1 + SHIFTS[now, 0], last)
        # the next place where a match may go on, farther out in ``b`` than the last one
        least_at = np.clip(np.maximum(p + more, last - SHIFTS + 1), 0, 63).astype(np.uint64)
        free = (runs_at >> least_at) << least_at
        p = np.where(free > 0, np.bitwise_count((free & ~(free - one)) - one), 64).min(0).astype(np.int64)
        alive = np.flatnonzero(p < width)
        rows, now, last, p, runs_at, free = rows[alive], now[alive], last[alive], p[alive], runs_at[:, alive], free[:, alive]
        at, each = p.astype(np.uint64), np.arange(len(rows))
        goes_on = (runs_at[now, each] >> at) & one > 0
        now = np.where(goes_on, now, _ones(free >> at).argmax(0))
        current = runs_at[now, each]
        turns.append((rows, p, SHIFTS[now]))
    n //= 2
    # c is on both sides
    count = np.bitwise_count(bits).astype(np.int64)
    pairs = np.flatnonzero(count[:n] + count[n:] - 1 >= least)
    kept = np.concatenate([pairs, n + pairs])
    place = np.full(2 * n, -1)
    place[kept] = np.arange(len(kept))
    by = np.zeros((len(kept), width), np.int8)
    for rows, p, shift in turns:
        to = place[rows]
        some = to >= 0
        to = to[some]
        by[to] = np.where(np.arange(width) >= p[some, None], shift[some], by[to])
    held = np.unpackbits(bits[kept].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width].astype(bool)
    return pairs, held, by


def _bridged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first, last, first, last) of the pairs of rows that are similar as in _verify, for contexts
    in which words may be inserted or left out: the Jaccard similarity of runs around c, aligned with
    shifts on either side of it.  ``a``, ``b``: their _planes."""
    left, right = _runs_at(a[0], b[0]), _runs_at(a[1], b[1])
    most = sum(np.bitwise_count(np.bitwise_or.reduce(x) | np.uint64(1)).astype(np.int64) for x in (left, right)) - 1
    rows = np.flatnonzero(most >= NEED)
    # the other run may be shorter, but holds the matches
    least = int(np.ceil(SIMILARITY * RUN - 1e-9))
    some, both_m, both_s = _shifted(np.concatenate([left[:, rows], right[:, rows]], 1), least)
    rows, n = rows[some], len(some)
    lm, rm, ls, rs = both_m[:n], both_m[n:], both_s[:n], both_s[n:]
    m = np.concatenate([lm[:, :0:-1], rm], 1)
    # the place in ``b`` that goes with each place of ``a``
    there = np.arange(2 * REACH + 1, dtype=np.int16) + np.concatenate([-ls[:, :0:-1], rs], 1)
    total = np.zeros((n, m.shape[1] + 1), np.int16)
    np.cumsum(m, axis=1, out=total[:, 1:])
    place = np.arange(m.shape[1])
    ok = np.zeros(n, bool)
    first, last = np.full(n, 2 * REACH), np.zeros(n, np.int64)
    for width in LENGTHS:
        # the run is to hold c
        low, high = max(0, REACH - width + 1), min(REACH, 2 * REACH + 1 - width) + 1
        both = total[:, low + width:high + width] - total[:, low:high]
        other = there[:, low + width - 1:high + width - 1] - there[:, low:high] + 1
        run = (both >= SIMILARITY * (width + other - both) - 1e-9) & (np.maximum(width, other) >= RUN)
        good = run.any(1)
        ok |= good
        first = np.where(good, np.minimum(first, low + run.argmax(1)), first)
        last = np.where(good, np.maximum(last, high + width - 2 - run[:, ::-1].argmax(1)), last)
    rows, m, there, first, last = rows[ok], m[ok], there[ok], first[ok], last[ok]
    held = m & (place >= first[:, None]) & (place <= last[:, None])
    lo, hi = held.argmax(1), 2 * REACH - held[:, ::-1].argmax(1)
    at = np.arange(len(rows))
    return rows, lo, hi, there[at, lo], there[at, hi]


#: places (outwards from c, to the left and to the right) of a cheap look
LOOK = np.array([sum(1 << d for d in range(1, 23, 3)), sum(1 << d for d in range(2, 21, 3))], np.uint64)


def _verify(contexts: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mask, first, last, first, last): whether some run around c is similar (NEED places match as
    they stand, or with shifts), and the first and last match of such runs (places in the contexts
    of i and of j).  ``contexts``: the codes of the rows, and their _planes."""
    codes, planes = contexts
    ok, ends = np.zeros(len(i), bool), np.zeros((4, len(i)), np.int64)
    place = np.arange(2 * REACH + 1)
    for k in range(0, len(i), 1 << 12):
        x, y = i[k:k + (1 << 12)], j[k:k + (1 << 12)]
        a, b = planes[:, x], planes[:, y]
        match = _same(np.moveaxis(a, 2, 0), np.moveaxis(b, 2, 0))
        # cheap look first: a part near c is the same
        some = np.bitwise_count(match & LOOK[:, None]).sum(0) >= 3
        whole = np.bitwise_count(match).astype(np.int64).sum(0) - (match[0] & np.uint64(1)).astype(np.int64)
        at = np.flatnonzero(some & (whole >= NEED))
        m = (codes[x[at]] == codes[y[at]]) & (codes[x[at]] > 0)
        total = np.zeros((len(at), m.shape[1] + 1), np.int16)
        np.cumsum(m, axis=1, out=total[:, 1:])
        run = total[:, RUN:] - total[:, :-RUN] >= NEED
        good = run.any(1)
        at, m, run = at[good], m[good], run[good]
        ok[k + at] = True
        # from the first match of the first such run to the last match of the last one
        first, last = run.argmax(1), 2 * REACH - run[:, ::-1].argmax(1)
        held = m & (place >= first[:, None]) & (place <= last[:, None])
        ends[0::2, k + at] = held.argmax(1)
        ends[1::2, k + at] = 2 * REACH - held[:, ::-1].argmax(1)
        some[at] = False
        rest = np.flatnonzero(some)
        found, *where = _bridged(a[:, rest], b[:, rest])
        ok[k + rest[found]] = True
        ends[:, k + rest[found]] = np.stack(where)
    return ok, *ends


def _islands(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(doc, start, end) of the spans, those of a document that touch joined."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(end + (number << 40)) - (number << 40)
    first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (start[1:] > reach[:-1])]))
    return np.stack([doc[first], start[first], np.maximum.reduceat(end, first)], 1)


def _matches(rows: DataFrame) -> DataFrame:
    """(a, b) edges between documents, and (a, start, end) runs in words of document a."""
    keys = ["key", "p", "q"]
    # alike contexts side by side: most members are connected by their neighbours.  The number of tasks follows the rows: to Spark the input is small, but
    # each of its bytes is compared for long
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    pairs = blocked(rows, ["key"], "doc", BLOCK).repartition(tasks, *keys).sortWithinPartitions(*keys, "ctx")
    names = pairs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs((pa.RecordBatch.from_arrays(b.columns, names) for b in batches), keys):
            col = {c: t[c].to_numpy() for c in ("key", "p", "q", "blk", "doc")}
            starts = run_starts([col[k] for k in keys])
            ends = np.append(starts[1:], t.num_rows)
            size = ends - starts
            doc, n = col["doc"], t.num_rows
            # two rows of one block are compared where the block is paired with itself, or are neighbours
            block = np.where(col["p"] == col["q"], -1 - n - np.arange(n), col["blk"])
            links = _Links(_codes(t["ctx"]), doc, np.repeat(np.arange(len(starts)), size), block)
            links.neighbours()
            links.rest()
            links.widest()
            a, b = forest(n, np.concatenate(links.left), np.concatenate(links.right))
            lo, hi = links.lo, links.hi
            hit = np.flatnonzero(hi >= 0)
            edges = np.unique(np.stack([doc[a], doc[b]], 1), axis=0)
            # a row's run stands at all of its places
            places = t["places"].take(pa.array(hit)).combine_chunks()
            hit = np.repeat(hit, np.diff(places.offsets.to_numpy()))
            at = places.flatten().to_numpy().astype(np.int64) - REACH
            spans = _islands(doc[hit], at + lo[hit], at + hi[hit] + SHINGLE)
            none = np.zeros(len(edges), np.int64)
            yield pa.record_batch({
                "a": pa.array(np.concatenate([edges[:, 0], spans[:, 0]])), "b": pa.array(np.concatenate([edges[:, 1], np.full(len(spans), -1)])),
                "edge": pa.array(np.arange(len(edges) + len(spans)) < len(edges)),
                "start": pa.array(np.concatenate([none, spans[:, 1]])), "end": pa.array(np.concatenate([none, spans[:, 2]]))})

    return pairs.mapInArrow(work, "a long, b long, edge boolean, start long, end long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id, kept, n_spans, n_repeated_words, spans), one row per row of ``docs``.

    Documents that share a near-duplicate passage of at least LEAST_WORDS words are linked;
    component_id is the smallest doc_id reachable (the own one included) and kept says that it is
    the own one.  spans lists the passages shared with other documents as ``start:end`` in words
    (end exclusive), overlapping ones joined.

    Null and empty texts, and texts shorter than a passage, share nothing.  Repeats inside one
    document, and rows with equal doc_id, are no links; a row with a null doc_id takes no part (null
    component, not kept).  Other columns are ignored; an empty table gives no rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.where("doc_id is not null and text is not null")
    shared = materialize(_emit(texts, False).groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                         .where("lo < hi").select("key"), "passage-keys")
    rows = materialize(_emit(texts, True).join(shared, "key"), "passage-windows")
    found = materialize(_matches(rows), "passage-links")
    comp = components(found.where("edge").select("a", "b"))
    spans = found.where("not edge").select(F.col("a").alias("node"), "start", "end").distinct()
    before = Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(Window.partitionBy("node").orderBy("start", "end")))
    spans = spans.groupBy("node", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    spans = spans.groupBy("node").agg(F.count("*").alias("n_spans"), F.sum(F.col("e") - F.col("s")).alias("n_repeated_words"),
                                      F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda x: F.concat(x["s"], F.lit(":"), x["e"]))).alias("spans"))
    facts = comp.join(spans, "node", "left")
    component = F.coalesce("component_id", F.col("doc_id"))
    return own.select("doc_id").join(facts, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("n_repeated_words", F.lit(0)).cast("long").alias("n_repeated_words"), F.coalesce("spans", F.lit("")).alias("spans"))
