"""Vectorised text measures over Arrow string columns (numpy inside tasks).

All helpers see texts as UTF-8 bytes.  Words are ``[^\\x20\\x09-\\x0D]+``; the six separators are
ASCII, so splitting the bytes is the same as splitting the code points.  A null text is empty.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# bytes of text handled at once inside a task (one longer text is handled alone)
CHUNK_BYTES = 3 << 19

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[32, 9, 10, 11, 12, 13]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift-multiply finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for k, b in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, b, _U)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["q"][:n]


@dataclass
class Texts:
    """Texts ``lo..hi`` of a batch: their bytes and byte offsets (n + 1)."""
    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions lie in each text."""
        return np.diff(np.searchsorted(positions, self.offs))


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Split an Arrow string column into runs of whole texts of about ``max_bytes``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Texts(lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def word_spans(t: Texts, separator: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per text) of every word, byte positions in ``t.buf``; ``separator`` says
    which of the 256 bytes part words."""
    n = len(t.buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(t.n, np.int64)
    word = ~separator[t.buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = t.offs[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = t.offs[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, t.per_text(starts)


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        p, self._q = _powers(n + 1)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(_BYTE_VALUE[buf] * p[:n], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sum[ends] - self._sum[starts]) * self._q[starts]
        return mix64(h + (ends - starts).astype(_U) * _U(0x632BE59BD9B4E019))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (order matters); length n - k + 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _U(0x9FB21C651E98DF25) + h[i:n + i]
    return mix64(out)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the values that occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of a per-item array for each text, items in text order, ``counts`` items each."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    e = np.cumsum(counts)
    return c[e] - c[e - counts]
