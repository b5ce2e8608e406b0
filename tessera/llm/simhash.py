"""SimHash near-duplicates by fuzzy Golay-code keys.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits).  The perfect (23, 12, 7) Golay
code decodes any 23-bit word to a codeword at distance 3 at most, so a segment and its one-bit
neighbours decode to between one and six codewords: those indices are the segment's fuzzy keys, and
two segments that differ in one bit share one.  With two errors over three segments, some segment
has none and the next one (cyclically) has one at most, so two fingerprints at distance 2 share the
key (exact segment, fuzzy key of the next).  Candidates of a key are verified by their bit distance.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import bucket_links, components

MAX_BITS = 2
SHINGLE = 3
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
# generator of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value)
_GENERATOR = 0b110001110101


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit word's byte parts, error pattern of each syndrome)."""
    def syndrome(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= _GENERATOR << (i - 11)
        return w
    unit = [syndrome(1 << i) for i in range(23)]
    error = np.zeros(2048, np.uint32)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    parts = np.zeros((3, 256), np.uint32)
    for k in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * k + i < 23:
                    parts[k, v] ^= unit[8 * k + i]
    return parts, error


_PARTS, _ERROR = _golay_tables()


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    w = words.astype(np.uint32)
    s = _PARTS[0][w & 255] ^ _PARTS[1][w >> 8 & 255] ^ _PARTS[2][w >> 16 & 255]
    return (w ^ _ERROR[s]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits + 1) indices of the codewords near each word: its own and its neighbours'."""
    out = [golay_index(words)] + [golay_index(words ^ np.uint32(1 << i)) for i in range(bits)]
    return np.stack(out, 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text (see ``fingerprints``)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    if len(words) > shingle:
        start, end = start[:len(words) - shingle + 1], end[shingle - 1:]
    else:
        start, end = start[:1], end[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(start), 1 << 16):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(start[lo:lo + (1 << 16)].tolist(), end[lo:lo + (1 << 16)].tolist())], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    top = 2 * ones > len(start)
    return int.from_bytes(np.packbits(top).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp the 64-bit SimHash as a signed long: words of the text with A-Z
    lower-cased, shingles of ``shingle`` words (fewer words: all of them; none: 0), XXH64 of each
    with seed 42; a bit is 1 where over half of the shingles have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in rb.column(1)], np.uint64)
            yield pa.record_batch({"doc_id": rb.column(0).cast(pa.int64()), "fp": pa.array(fps.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(kind int, exact int, near int, fp, node) for every distinct key of each fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            signed = rb.column(0).to_numpy()
            fp, node = signed.view(np.uint64), rb.column(1).to_numpy()
            part = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.uint32) for s, b in _SEGMENTS]
            for kind in range(3):
                after = (kind + 1) % 3
                near = np.sort(segment_keys(part[after], _SEGMENTS[after][1]), 1)
                first = np.ones(near.shape, bool)
                first[:, 1:] = near[:, 1:] != near[:, :-1]
                row, col = np.nonzero(first)
                yield pa.record_batch({
                    "kind": pa.array(np.full(len(row), kind, np.int32)),
                    "exact": pa.array(part[kind][row].astype(np.int32)),
                    "near": pa.array(near[row, col].astype(np.int32)),
                    "fp": pa.array(signed[row]), "node": pa.array(node[row])})

    return fps.select("fp", "node").mapInArrow(work, "kind int, exact int, near int, fp long, node long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``: documents whose fingerprints
    differ in ``max_bits`` (0 to 2) or fewer bits are linked; component_id is the smallest doc_id
    reachable, the document's own included.

    Equal fingerprints are one node (the smallest of their doc_ids), so copies cost one row each
    and no pairs.  Null, empty and word-free texts have fingerprint zero and are linked like any
    other.  A row with a null doc_id gets a fingerprint and the component of its fingerprint, but
    is never a representative (null if no row of its fingerprint has an id).  Repeated rows give
    repeated rows.  Other columns are ignored; an empty table gives an empty result."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the key scheme covers 0 to 2 differing bits")
    docs_fp = materialize(fingerprints(docs, shingle), "simhash-fp")
    nodes = materialize(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-nodes")

    def link(c: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(c["fp"][i] ^ c["fp"][j]) <= max_bits

    if max_bits:
        keys = materialize(fuzzy_keys(nodes), "simhash-keys")
        comp = components(bucket_links(keys, ["kind", "exact", "near"], "node", ["fp"], link))
        nodes = nodes.join(comp, "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    else:
        nodes = nodes.select("fp", F.col("node").alias("component_id"))
    return docs_fp.join(nodes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
