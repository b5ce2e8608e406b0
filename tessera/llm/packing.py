"""Sequence packing: documents to tokens, tokens to pieces, pieces into sequences by vector best-fit.

Tokenising is one pass over whole texts with no shuffle; only the short piece rows (no text, no ids)
are dealt out again.  Pieces that fill a sequence alone need no packing.  The others are dealt into
groups of about GROUP pieces; within a group, pieces in falling length choose among the open bins
that have room in every dimension (tokens, documents, attention cost) by weighted dot-product or by
the weighted norm of what would remain.  The waste is a fraction of a sequence for each group.
"""
from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textnum as tn

CAPACITY = 1024
GROUP = 4096
END_ID = 2
# distinct pieces whose ids a worker remembers; beyond it the memory starts anew
REMEMBER = 800_000

_L, _N, _W, _O = 1, 2, 3, 4
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _L
_CLASS[48:58] = _N
_CLASS[[9, 10, 11, 12, 13, 32]] = _W
# bytes of texts that the vectorised splitter leaves to the tokenizer itself: controls, and letters
# beyond U+024F (whose classes it does not know)
_HARD = np.zeros(256, bool)
_HARD[[*range(9), *range(14, 32), 0x27, 0x7F, 0xC2, *range(0xCA, 0x100)]] = True


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts with a byte-level BPE of ``tokenizers``.

    The tokenizer splits a text into pieces (a word with its space, digits, signs, white space) and
    merges within a piece only.  Here the pieces of plain texts are found in numpy and each distinct
    piece is encoded once by the tokenizer; texts with other signs go to the tokenizer whole.  The
    ids are the same."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks are the parallel units
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text), by the tokenizer alone."""
        flat, count = [], np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), 2000):
            ids = [e.ids for e in self.tok.encode_batch(texts[lo:lo + 2000], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            count[lo:lo + len(ids)] = n
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), count

    def words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``whole`` for pieces of a blank and letters: run together they are a text that the
        tokenizer splits into the same pieces, and it says which piece each id belongs to."""
        flat, count = [], np.zeros(len(pieces), np.int64)
        for lo in range(0, len(pieces), 1000):
            part = pieces[lo:lo + 1000]
            e = self.tok.encode("".join(part), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            if len(of) and of[-1] + 1 == len(part):
                flat.append(np.array(e.ids, np.int32))
                count[lo:lo + len(part)] = np.bincount(of, minlength=len(part))
            else:
                ids, count[lo:lo + len(part)] = self.whole(part)
                flat.append(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), count

    @staticmethod
    def hard(t: tn.Texts) -> np.ndarray:
        """Texts that the splitter does not handle."""
        b = t.buf
        bad = _HARD[b]
        # the multiplication and division signs are the only non-letters of U+00C0 to U+024F
        sign = np.flatnonzero(b[:-1] == 0xC3) if len(b) else np.zeros(0, np.int64)
        sign = sign[(b[sign + 1] == 0x97) | (b[sign + 1] == 0xB7)]
        at = np.sort(np.concatenate([np.flatnonzero(bad), sign, np.flatnonzero(b == 60)]))
        return t.per_text(at) > 0

    @staticmethod
    def split(t: tn.Texts) -> np.ndarray:
        """Byte positions where the pieces of ``t`` begin."""
        b, n = t.buf, len(t.buf)
        cls = _CLASS[b]
        space = cls == _W
        start = np.zeros(n, bool)
        start[1:] = cls[1:] != cls[:-1]
        # a single blank before a word belongs to the word; other white space stays alone
        start[1:] &= ~((b[:-1] == 32) & ~space[1:])
        # the last of several white-space signs begins a piece if a word follows
        if n > 2:
            start[1:-1] |= space[:-2] & space[1:-1] & ~space[2:]
        first = t.offs[:-1]
        first = first[first < n]
        # at the end of a text nothing follows
        last = t.offs[1:] - 1
        last = last[(last >= 1) & (last < n)]
        last = last[space[last] & space[last - 1]]
        start[last] = False
        start[first] = True
        return np.flatnonzero(start)

    def pieces(self, t: tn.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text) of plain texts."""
        starts = self.split(t)
        per_text = t.per_text(starts)
        ends = np.append(starts[1:], len(t.buf))
        h = tn.SpanHash(t.buf)(starts, ends)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, u), max(0, len(self.known) - 1))
        new = self.known[at] != u if len(self.known) else np.ones(len(u), bool)
        if new.any():
            raw = t.buf.tobytes()
            new = np.flatnonzero(new)
            s, e = starts[first[new]], ends[first[new]]
            word = (t.buf[s] == 32) & (_CLASS[t.buf[np.minimum(s + 1, len(t.buf) - 1)]] == _L) & (e > s + 1)
            for mask, encode in ((word, self.words), (~word, self.whole)):
                fresh = u[new[mask]]
                ids, count = encode([raw[a:b].decode() for a, b in zip(s[mask].tolist(), e[mask].tolist())])
                place = len(self.flat) + np.cumsum(count) - count
                self.flat = np.concatenate([self.flat, ids])
                at = np.searchsorted(self.known, fresh)
                self.known = np.insert(self.known, at, fresh)
                self.place = np.insert(self.place, at, place)
                self.count = np.insert(self.count, at, count)
        at = np.searchsorted(self.known, u)[inverse]
        count = self.count[at]
        total = int(count.sum())
        begin = np.cumsum(count) - count
        ids = self.flat[np.repeat(self.place[at] - begin, count) + np.arange(total)]
        return ids, tn.sums_by_text(count, per_text)

    def __call__(self, t: tn.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        if not len(t.buf):
            return np.zeros(0, np.int32), np.zeros(t.n, np.int64)
        hard = self.hard(t)
        if not hard.any():
            return self.pieces(t)
        # runs of plain texts in numpy, the others one by one
        ids, counts = [], np.zeros(t.n, np.int64)
        edge = np.flatnonzero(np.diff(hard)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), t.n]):
            s, e = t.offs[lo], t.offs[hi]
            if hard[lo]:
                raw = t.buf[s:e].tobytes()
                own, counts[lo:hi] = self.whole([raw[a - s:b - s].decode() for a, b in zip(t.offs[lo:hi], t.offs[lo + 1:hi + 1])])
                ids.append(own)
            elif e > s:
                part, counts[lo:hi] = self.pieces(tn.Texts(0, hi - lo, t.buf[s:e], t.offs[lo:hi + 1] - s))
                ids.append(part)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece of each row of ``docs``.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut, into pieces of
    ``capacity`` ids, of which the first may be shorter.  Null and empty texts are ``end_id`` alone."""
    path = tokenizer or default_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for rb in batches:
            for t in tn.chunks(rb.column(1)):
                ids, counts = encode(t)
                total = counts + 1
                end = np.cumsum(total)
                flat = np.empty(int(end[-1]), "<u4")
                closing = np.zeros(len(flat), bool)
                closing[end - 1] = True
                flat[~closing] = ids
                flat[closing] = end_id
                n = -(-total // capacity)
                doc = np.repeat(np.arange(t.n), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                short = total - (n - 1) * capacity
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                at = (end - total)[doc] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.record_batch({
                    "doc_id": rb.column(0).slice(t.lo, t.n).cast(pa.int64()).take(pa.array(doc)),
                    "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, capacity: int, max_docs: int, max_attention: float,
             weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  Pieces are taken in falling length; each goes to the open bin
    that has room for it in all three dimensions and is best by ``rule``: ``norm``, the smallest
    weighted norm of the residual vector afterwards; ``dot``, the largest weighted dot-product of
    the residual and the piece.  A piece that fits no open bin opens one (ties: the oldest bin)."""
    caps = np.array([capacity, max_docs, max_attention], float)
    w = np.array(weights)
    n = len(length)
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, max(n, 1)))
    used = np.zeros(max(n, 1), np.int64)
    opened = 0
    live = np.zeros(0, np.int64)
    smallest = int(length.min()) if n else 0
    for k, i in enumerate(np.argsort(-length, kind="stable")):
        item = np.array([length[i], 1.0, float(length[i]) ** 2])
        r = left[:, live]
        fits = np.flatnonzero((r[0] >= item[0]) & (r[1] >= 1) & (r[2] >= item[2]))
        if len(fits):
            x = r[:, fits]
            if rule == "norm":
                best = np.argmin(w @ ((x - item[:, None]) / caps[:, None]) ** 2)
            else:
                best = np.argmax(w @ (x * item[:, None] / (caps * caps)[:, None]))
            b = live[fits[best]]
        else:
            b = opened
            opened += 1
            left[:, b] = caps
            live = np.append(live, b)
        bins[i], offset[i] = b, used[b]
        used[b] += length[i]
        left[:, b] -= item
        if k % 256 == 255:
            r = left[:, live]
            live = live[(r[0] >= smallest) & (r[1] >= 1) & (r[2] >= smallest ** 2)]
    return bins, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None,
         rule: str = "norm", group: int = GROUP, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``max_docs`` (default: ``capacity``, never short of room) and ``max_attention`` (sum of squared
    piece lengths; default ``capacity`` squared, likewise) bound a sequence besides its tokens; a
    piece that breaks a cap alone has a sequence of its own.  Rows with equal or null doc_id are
    packed as documents of their own; other columns are ignored; an empty table packs to nothing.
    Offsets are gapless from 0 within a sequence."""
    max_docs = capacity if max_docs is None else max_docs
    max_attention = float(capacity) ** 2 if max_attention is None else float(max_attention)
    cut = materialize(pieces(docs, capacity, tokenizer=tokenizer), "pieces")
    alone = F.col("length") >= capacity
    if max_attention < capacity ** 2:
        alone = alone | (F.col("length") * F.col("length") > max_attention)
    full = (cut.where(alone).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
            .withColumn("offset", F.lit(0).cast("long")))
    rest = cut.where(~alone)
    groups = max(1, math.ceil(rest.count() / group))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def packed(t: pa.Table, first: int) -> pa.Table:
            bins, offset = best_fit(t["length"].to_numpy(), capacity, max_docs, max_attention, rule=rule)
            return (t.append_column("sequence_id", pa.array((bins + first) * 2))
                    .append_column("offset", pa.array(offset)))
        for rb in batches:
            held.append(rb)
            if sum(x.num_rows for x in held) >= 2 * group:
                t = pa.Table.from_batches(held)
                yield from packed(t, first).to_batches()
                first, held = first + t.num_rows, []
        if held:
            yield from packed(pa.Table.from_batches(held), first).to_batches()

    names = cut.schema.simpleString()[7:-1].replace(":", " ").replace("bigint", "long")
    packed = rest.repartition(groups).mapInArrow(work, names + ", sequence_id long, offset long")
    return packed.unionByName(full)
