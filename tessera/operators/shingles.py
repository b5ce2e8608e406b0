"""Word shingles of texts in numpy, inside tasks (D3).

A word is a run of letters and numbers of the lower-cased text, as in
``regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ')``; a shingle is the 64-bit hash of three words
next to each other, or of all words of a text of one or two.  Spark lower-cases the texts and says
which characters are letters and numbers.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text handled at once; one longer text is handled alone
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_KEPT: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_ASCII = np.zeros(256, bool)
_ASCII[[c for c in range(128) if chr(c).isalnum()]] = True


def letters(spark: SparkSession) -> np.ndarray:
    """Bits of the code points that Spark's regular expressions take for a letter or a number."""
    if "letters" not in _KEPT:
        ids = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343")
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = ids.filter(char.rlike(r"[\p{L}\p{N}]")).toArrow().column(0).to_numpy()
        known = np.zeros(0x110000, bool)
        known[found] = True
        _KEPT["letters"] = np.packbits(known)
    return _KEPT["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _KEPT or len(_KEPT["p"]) < n:
        for k, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(max(n, CHUNK_BYTES + 1), base, _U)
            a[0] = 1
            _KEPT[k] = np.multiply.accumulate(a)
    return _KEPT["p"][:n], _KEPT["q"][:n]


def word_bytes(buf: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters and numbers (``known``: whether a code point is one)."""
    word = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    if not len(lead):
        return word
    b = buf[lead].astype(np.int32)
    width = 2 + (b >= 0xE0) + (b >= 0xF0)
    after = np.concatenate([buf, np.zeros(3, np.uint8)])
    point, whole = b & np.where(width == 2, 31, np.where(width == 3, 15, 7)), b < 0xF5
    for k in (1, 2, 3):
        c = after[lead + k]
        point = np.where(width > k, point << 6 | c & 63, point)
        whole &= (width <= k) | (c & 0xC0 == 0x80)
    ok = np.flatnonzero(whole & known[np.where(whole, np.minimum(point, 0x10FFFF), 0)])
    for k in range(4):
        word[lead[ok[width[ok] > k]] + k] = True
    return word


def _chunks(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null text is empty."""
    col = col.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1, lo + 1)
        yield lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def _shingles(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles, by text; ``word``: the word_bytes of ``buf``."""
    n = len(offs) - 1
    before, after = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    before[1:], after[:-1] = word, word
    before[offs], after[offs] = False, False
    # a word starts where none stands before it in its text, and ends likewise
    starts = np.flatnonzero(word & ~before[:-1])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    p, q = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE_VALUE[buf] * p[:-1], out=total[1:])
    h = mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(_U) * _U(0x632BE59BD9B4E019))
    many = np.diff(np.searchsorted(starts, offs))
    text = np.repeat(np.arange(n), many)
    of, value = [text[:0]], [h[:0]]
    for k, kept in ((3, many >= 3), (2, many == 2), (1, many == 1)):
        m = len(h) - k + 1
        if m <= 0 or not kept.any():
            continue
        whole = np.flatnonzero((text[:m] == text[k - 1:]) & kept[text[:m]])
        x = np.full(len(whole), k, _U)
        for i in range(k):
            x = x * _U(0x9FB21C651E98DF25) + h[whole + i]
        of.append(text[whole])
        value.append(mix64(x))
    of, value = np.concatenate(of), np.concatenate(value)
    # by text and the first 44 bits of the hash; where that leaves an order open, by all of it
    key = of.astype(_U) << _U(44) | value >> _U(20)
    order = np.argsort(key)
    key, x = key[order], value[order]
    if n > 1 << 20 or ((key[1:] == key[:-1]) & (x[1:] != x[:-1])).any():
        order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[new], value[new]


def _digests(buf: np.ndarray, offs: np.ndarray, word: np.ndarray, texts: np.ndarray) -> list[bytes]:
    """SHA-256 of the words of each of ``texts``, a space between them."""
    kept = word.copy()
    kept[1:] |= word[:-1]
    # the byte after a word stands for the space; one that begins a text is none
    first = offs[:-1][offs[:-1] < len(buf)]
    kept[first] = word[first]
    plain = np.where(word, buf, np.uint8(32))[kept].tobytes()
    ends = np.concatenate([[0], np.cumsum(kept)])[offs]
    return [hashlib.sha256(plain[ends[t]:ends[t + 1]].rstrip(b" ")).digest() for t in texts.tolist()]


def _texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, np.ndarray]:
    own = df.select(id_col, F.lower(F.col(text_col)).alias("_text"))
    return own, f"`{id_col}` {own.schema[0].dataType.simpleString()}", letters(df.sparkSession)


def _lists(value: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64), pa.int64()))


def shingle_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles): the distinct shingles of each text, always in the same order; texts without
    a word have no row."""
    own, schema, bits = _texts(df, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits).astype(bool)
        for rb in batches:
            for lo, buf, offs in _chunks(rb.column(1)):
                of, value = _shingles(buf, offs, word_bytes(buf, known))
                texts, starts = np.unique(of, return_index=True)
                yield pa.record_batch({id_col: rb.column(0).take(pa.array(texts + lo)),
                                       "shingles": _lists(value, np.append(starts, len(of)))})

    return own.mapInArrow(work, f"{schema}, shingles array<bigint>")


def signatures(df: DataFrame, id_col: str, text_col: str, num_perm: int) -> DataFrame:
    """(id, words, size, sig) of each text with a word, from one reading: SHA-256 of its words, number
    of its shingles, and its MinHash signature (minima of ``num_perm`` functions of the shingles)."""
    own, schema, bits = _texts(df, id_col, text_col)
    seeds = np.arange(1, num_perm + 1, dtype=_U)
    times, plus = mix64(seeds * _U(_BASE)) | _U(1), mix64(seeds * _U(0xD1342543DE82EF95))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits).astype(bool)
        for rb in batches:
            for lo, buf, offs in _chunks(rb.column(1)):
                word = word_bytes(buf, known)
                of, value = _shingles(buf, offs, word)
                texts, starts = np.unique(of, return_index=True)
                sig = np.empty((len(texts), num_perm), _U)
                if len(texts):
                    for k in range(num_perm):
                        sig[:, k] = np.minimum.reduceat(value * times[k] + plus[k], starts)
                yield pa.record_batch({
                    id_col: rb.column(0).take(pa.array(texts + lo)), "words": pa.array(_digests(buf, offs, word, texts), pa.binary()),
                    "size": pa.array(np.diff(np.append(starts, len(of))), pa.int32()),
                    "sig": _lists(sig.ravel(), np.arange(len(texts) + 1) * num_perm)})

    return own.mapInArrow(work, f"{schema}, words binary, size int, sig array<bigint>")
