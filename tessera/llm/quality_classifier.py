"""Quality classifier by co-training of a text view and a page-metadata view.

Text view: which letter words a document has, and how its words repeat.  Metadata view: source,
language, length and layout (lines, capitals, signs), no words.  Each view is a logistic regression
in numpy on a bounded sample of labelled rows.  In every round both views score all documents that
are not in that sample, in one Spark pass, and each hands those it is sure of to the other: as
counts, by class, of the documents that hold a feature, from which the other view's weights then
start.  The counts are summed by Spark; the driver holds one pair of numbers for each feature.  Both
views are then calibrated on held-out labels, combined there, and score all documents in one more
pass.  No pass shuffles texts.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..session import materialize
from . import textnum as tn

LABELLED = 20_000      # labelled documents the model is fitted on, about, at most (smallest hashes of doc_id)
LABELLED_BYTES = 256 << 20     # of their features, about, at most
ROUNDS = 3
SURE = 0.98            # confidence from which a view's judgement becomes a pseudo-label
THRESHOLD = 0.5
WORDS = 1 << 18        # hashed word features; behind them come bins of measures
_BINS = 16
_MEASURES = 12
DIM = WORDS + _BINS * _MEASURES
META_DIM = (1 << 12) + _BINS * _MEASURES
META_SIZE = 9          # features of a document in the metadata view
ADDED = ("p_text", "p_meta", "score", "kept")

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100), *range(0x80, 0xC0)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _flags(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SIGNS = _flags(*b"#*$%&|<>{}[]=_^~\\")
_BANG = _flags(*b"!?")
_UPPER = _flags(*range(65, 91))
_DIGIT = _flags(*range(48, 58))


def _count(mask: np.ndarray, t: tn.Texts) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[t.offs[1:]] - c[t.offs[:-1]]


def _bins(values: list[np.ndarray], logs: list[bool], base: int, n: int) -> np.ndarray:
    """(n, len(values)) feature numbers: shares in sixteenths, counts by their logarithm."""
    out = np.empty((n, len(values)), np.int64)
    for k, (v, log) in enumerate(zip(values, logs)):
        b = np.log2(v + 1.0) if log else v * _BINS
        out[:, k] = base + k * _BINS + np.clip(b, 0, _BINS - 1).astype(np.int64)
    return out


def features(t: tn.Texts, langs: list, sources: list) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted feature numbers of the text view for each text, (n, k) numbers of the other)."""
    n = t.n
    size = np.maximum(1, np.diff(t.offs))
    low = tn.Texts(t.lo, t.hi, _LOWER[t.buf], t.offs)
    s, e, words = tn.word_spans(low, _NOT_LETTER)
    h = tn.SpanHash(low.buf)(s, e)
    text = np.repeat(np.arange(n), words)
    key = np.unique((text.astype(np.int64) << 18) | (h >> np.uint64(46)).astype(np.int64))
    distinct = np.bincount(key >> 18, minlength=n)
    at = np.maximum(1, words)
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    again = tn.sums_by_text(follows, words)
    # growth of the vocabulary: distinct words against the square root of the length
    own = _bins([distinct / at, again / at, np.minimum(1.0, distinct / np.sqrt(at) / 32), np.log2(words + 1.0) / 16], [False] * 4, WORDS, n)
    lines = _count(t.buf == 10, t) + 1
    upper, signs, bang, digit = (_count(m[t.buf], t) for m in (_UPPER, _SIGNS, _BANG, _DIGIT))
    meta = _bins([size, lines, size / lines, upper / size, np.minimum(1, signs / size * 4), np.minimum(1, bang / size * 4),
                  np.minimum(1, digit / size * 4)], [True, True, True, False, False, False, False], 1 << 12, n)
    name = lambda x, salt: (hash_name(x) ^ salt) % (1 << 12)
    tags = np.array([[name(a, 0), name(b, 0x5A5)] for a, b in zip(langs, sources)], np.int64).reshape(n, 2)
    cut = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 18)
    return [np.concatenate([key[a:b] & (WORDS - 1), own[i]]) for i, (a, b) in enumerate(zip(cut, cut[1:]))], np.concatenate([meta, tags], 1)


def hash_name(x: str | None) -> int:
    import zlib
    return zlib.crc32((x or "").encode())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Handed:
    """What one view hands to the other: documents judged bad (0) and good (1), and how many of
    these hold each feature of the other view."""
    docs: np.ndarray      # (2,)
    counts: np.ndarray    # (2, features)


class Logistic:
    """Sparse logistic regression over present features, AdaGrad, deterministic.

    Weights start from ``odds`` times the log odds of a feature, counted over the rows and over what
    the other view ``handed``; of each class, that weighs as much as the rows do, at most."""

    def __init__(self, dim: int, rows: list[np.ndarray], y: np.ndarray, handed: Handed | None = None, odds: float = 0.0,
                 epochs: int = 12, least_z: float = 0.0, l2: float = 1e-5):
        self.w, self.b = np.zeros(dim), 0.0
        if len(set(y.tolist())) < 2:
            self.b = 8.0 if len(y) and y[0] else (-8.0 if len(y) else 0.0)
            return
        flat = np.concatenate(rows)
        label = np.repeat(y, [len(r) for r in rows])
        n = np.array([(y == c).sum() for c in (0, 1)], float)
        weight = np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0])) ** 0.5
        c = np.stack([np.bincount(flat[label == k], minlength=dim) for k in (0, 1)]).astype(float)
        if handed is not None:
            share = np.minimum(1.0, n / np.maximum(1, handed.docs))
            n = n + share * handed.docs
            c += share[:, None] * handed.counts
        use = c.sum(0) >= 4
        if least_z:      # words that are as common in either class say nothing and only add noise
            p = c.sum(0) / n.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.abs(c[1] / n[1] - c[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]))
            use &= (np.nan_to_num(z) >= least_z) | (np.arange(dim) >= WORDS)
        start = odds * (np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)))
        self.w[use] = np.where(np.arange(dim) < WORDS, start, 0.0)[use]
        rows = [r[use[r]] for r in rows]
        g2, gb = np.full(dim, 1e-8), 1e-8
        r = np.random.default_rng(5)
        for _ in range(epochs):
            for idx in np.array_split(r.permutation(len(rows)), max(1, len(rows) // 64)):
                f = np.concatenate([rows[i] for i in idx])
                n = np.array([len(rows[i]) for i in idx])
                owner = np.repeat(np.arange(len(idx)), n)
                z = np.bincount(owner, self.w[f], len(idx)) + self.b
                err = (_sigmoid(z) - y[idx]) * weight[idx]
                u, inv = np.unique(f, return_inverse=True)
                g = np.bincount(inv, err[owner], len(u)) + l2 * len(idx) * self.w[u]
                g2[u] += g * g
                self.w[u] -= 0.3 * g / np.sqrt(g2[u])
                gb += err.sum() ** 2
                self.b -= 0.3 * err.sum() / np.sqrt(gb)

    def __call__(self, rows: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(r) for r in rows], np.int64)
        if not len(rows):
            return np.zeros(0)
        f = np.concatenate(rows)
        return np.bincount(np.repeat(np.arange(len(rows)), n), self.w[f], len(rows)) + self.b


def _platt(z: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """(slopes..., offset) of a logistic fit of y on the columns of z, by Newton's method."""
    x = np.column_stack([z, np.ones(len(y))])
    c = np.zeros(x.shape[1])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = _sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(c))
        c -= np.linalg.solve(h, x.T @ (p - target) + l2 * c)
    return c


@dataclass
class Model:
    """Weights of both views, their calibrations and the combination; a few MB."""
    text: np.ndarray
    text_b: float
    meta: np.ndarray
    meta_b: float
    scale_text: np.ndarray
    scale_meta: np.ndarray
    mix: np.ndarray
    pseudo: int = 0

    def __call__(self, text: list[np.ndarray], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zt = _view(self.text, self.text_b)(text)
        zm = self.meta[meta].sum(1) + self.meta_b if len(meta) else np.zeros(0)
        zt, zm = np.clip(zt, -30, 30) * self.scale_text[0] + self.scale_text[1], np.clip(zm, -30, 30) * self.scale_meta[0] + self.scale_meta[1]
        return _sigmoid(zt), _sigmoid(zm), _sigmoid(np.column_stack([zt, zm]) @ self.mix[:2] + self.mix[2])


def _view(w: np.ndarray, b: float) -> Logistic:
    v = Logistic.__new__(Logistic)
    v.w, v.b = w, b
    return v


def _calibrated(w: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return _sigmoid(np.clip(w, -30, 30) * scale[0] + scale[1])


def fit(text: list[np.ndarray], meta: np.ndarray, y: np.ndarray, exchange: Callable, rounds: int = ROUNDS) -> Model:
    """Co-train on labelled rows (``y`` 1: good); ``exchange(text view, its scale, metadata view, its
    scale)`` gives what each view hands to the text view and to the metadata view."""
    y = np.asarray(y, np.int64)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    rows = list(meta)
    part = lambda of, mask: [r for r, m in zip(of, mask) if m]
    text_in, meta_in, y_in = part(text, ~held), part(rows, ~held), y[~held]
    text_out, meta_out, y_out = part(text, held), part(rows, held), y[held]
    to_text = to_meta = None
    pseudo = 0
    for k in range(rounds + 1):
        vt = Logistic(DIM, text_in, y_in, to_text, odds=0.7, least_z=4.0)
        # features of the metadata are few and go together, so that each has its part of the odds
        vm = Logistic(META_DIM, meta_in, y_in, to_meta, odds=0.0 if to_meta is None else 1 / META_SIZE)
        st, sm = (_platt(np.clip(v(out), -30, 30), y_out) if held.any() else np.array([1.0, 0.0])
                  for v, out in ((vt, text_out), (vm, meta_out)))
        if k == rounds or len(set(y.tolist())) < 2:
            break
        # views are sure in terms of calibrated scores, not of raw ones
        to_text, to_meta = exchange(vt, st, vm, sm)
        if not to_text.docs.any() and not to_meta.docs.any():
            break
        pseudo = int(to_text.docs.sum() + to_meta.docs.sum())
    if held.any():
        both = np.column_stack([np.clip(v(out), -30, 30) * s[0] + s[1] for v, out, s in ((vt, text_out, st), (vm, meta_out, sm))])
        mix = _platt(both, y_out)
    else:
        mix = np.array([0.5, 0.5, 0.0])
    return Model(vt.w.astype(np.float32), float(vt.b), vm.w.astype(np.float32), float(vm.b), st, sm, mix, pseudo)


def sure_of(p: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents judged bad, judged good) by the view that gives ``p``, but for those of which the
    other view is as sure of the opposite."""
    return (p <= 1 - SURE) & (other < SURE), (p >= SURE) & (other > 1 - SURE)


def exchanged(docs: DataFrame, known: np.ndarray, vt: Logistic, st: np.ndarray, vm: Logistic, sm: np.ndarray) -> tuple[Handed, Handed]:
    """What each view hands over of all ``docs`` (h, text, lang, source) whose h is not in ``known``
    (sorted): (to the text view, to the metadata view).  At most DIM + META_DIM + 4 rows come back."""
    wt, bt, wm, bm = vt.w, vt.b, vm.w, vm.b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, to_text, to_meta = _view(wt, bt), np.zeros((2, DIM + 1), np.int64), np.zeros((2, META_DIM + 1), np.int64)
        for rb in batches:
            new = ~np.isin(rb.column(0).to_numpy(zero_copy_only=False), known)
            lang, source = rb.column(2).to_pylist(), rb.column(3).to_pylist()
            for t in tn.chunks(rb.column(1)):
                text, meta = features(t, lang[t.lo:t.hi], source[t.lo:t.hi])
                if not t.n:
                    continue
                pt, pm = _calibrated(view(text), st), _calibrated(wm[meta].sum(1) + bm, sm)
                for c, (mine, theirs) in enumerate(zip(sure_of(pm, pt), sure_of(pt, pm))):
                    for i in np.flatnonzero(mine & new[t.lo:t.hi]):
                        to_text[c, text[i]] += 1         # a text's numbers are distinct
                        to_text[c, DIM] += 1
                    at = np.flatnonzero(theirs & new[t.lo:t.hi])
                    to_meta[c] += np.bincount(meta[at].ravel(), minlength=META_DIM + 1)
                    to_meta[c, META_DIM] += len(at)
        for k, counts in enumerate((to_text, to_meta)):
            f = np.flatnonzero(counts.any(0))
            yield pa.record_batch({"view": pa.array(np.full(len(f), k, np.int32)), "feature": pa.array(f.astype(np.int32)),
                                   "bad": pa.array(counts[0, f]), "good": pa.array(counts[1, f])})

    sums = (docs.select("h", "text", "lang", "source").mapInArrow(work, "view int, feature int, bad long, good long")
            .groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow())
    view, feature, bad, good = (sums.column(c).to_numpy() for c in ("view", "feature", "bad", "good"))
    out = []
    for k, dim in enumerate((DIM, META_DIM)):
        counts = np.zeros((2, dim + 1), np.int64)
        counts[:, feature[view == k]] = bad[view == k], good[view == k]
        out.append(Handed(counts[:, dim], counts[:, :dim]))
    return out[0], out[1]


def _featured(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lang, source = rb.column(3).to_pylist(), rb.column(4).to_pylist()
            for t in tn.chunks(rb.column(2)):
                text, meta = features(t, lang[t.lo:t.hi], source[t.lo:t.hi])
                yield pa.record_batch({"y": rb.column(1).slice(t.lo, t.n), "h": rb.column(0).slice(t.lo, t.n),
                                       "text": pa.array([r.astype(np.int32).tobytes() for r in text], pa.binary()),
                                       "meta": pa.array([r.astype(np.int32).tobytes() for r in meta], pa.binary())})

    return docs.select("h", "y", "text", "lang", "source").mapInArrow(work, "y int, h long, text binary, meta binary")


def _lowest(rows: DataFrame, share: float) -> DataFrame:
    """The rows whose hash ``h`` lies in the lowest ``share`` of its range."""
    return rows if share >= 1 else rows.where(F.col("h") < F.lit(int(-2 ** 63 + share * 2 ** 64)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on about LABELLED labelled documents, at most, those with the smallest hashes of doc_id,
    and fewer where their features take more than LABELLED_BYTES; of a repeated doc_id, one row.  All
    other documents, labelled or not, are scored in each round, and what the views are sure of is
    exchanged.  Good is quality 1 and not toxic; a document with several labels takes the worst;
    labels without a quality are not used; documents without an id have no label."""
    lab = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min(F.expr("int(quality = 1 and coalesce(toxic, 0) = 0)")).alias("y")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").withColumn("h", F.xxhash64("doc_id"))
    ids = rows.select("doc_id", "h").where("doc_id is not null").distinct().join(lab, "doc_id")
    share = LABELLED / max(1, ids.count())
    # about LABELLED rows
    chosen = _lowest(ids, share).select("doc_id", "y")
    sample = rows.where("doc_id is not null").join(F.broadcast(chosen), "doc_id")
    # of the rows of a doc_id the longest text, of equal lengths the smallest
    longest = F.min(F.struct(F.coalesce(-F.length("text"), F.lit(1)), "text", "lang", "source", "y", "h"))
    one = sample.groupBy("doc_id").agg(longest.alias("r")).select("r.*")
    held = materialize(_featured(one), "quality-sample")
    size = held.agg(F.sum(F.length("text") + F.length("meta"))).first()[0] or 0
    got = sorted(_lowest(held, min(1.0, share) * LABELLED_BYTES / size if size > LABELLED_BYTES else 1.0).collect(),
                 key=lambda r: (r["h"], bytes(r["text"])))
    read = lambda r, k: np.frombuffer(r[k], np.int32)
    known = np.array([r["h"] for r in got], np.int64)
    return fit([read(r, "text") for r in got], np.stack([read(r, "meta") for r in got]) if got else np.zeros((0, 0), np.int32),
               np.array([r["y"] for r in got], np.int64), lambda *views: exchanged(rows, known, *views))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_text, p_meta, score and kept (score >= threshold) appended, in one pass.

    Null and empty texts have no words and are judged by what is left; null languages and sources
    are the empty name; repeated rows are judged alike; any length of text is read whole; an empty
    table gives no rows.  Other columns pass through, but for columns of the four names, which give
    way to the new ones."""
    names = [c for c in docs.columns if c.lower() not in ADDED]
    docs = docs.select(*names)
    at = {c: names.index(c) for c in ("text", "lang", "source")}
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lang, source = rb.column(at["lang"]).to_pylist(), rb.column(at["source"]).to_pylist()
            for t in tn.chunks(rb.column(at["text"])):
                text, meta = features(t, lang[t.lo:t.hi], source[t.lo:t.hi])
                pt, pm, p = model(text, meta)
                yield pa.RecordBatch.from_arrays([*rb.slice(t.lo, t.n).columns, pa.array(pt), pa.array(pm), pa.array(p), pa.array(p >= threshold)],
                                                 names=[*names, *ADDED])

    out = StructType([*schema.fields, *[StructField(c, DoubleType()) for c in ADDED[:3]], StructField("kept", BooleanType())])
    return docs.mapInArrow(work, out)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled documents and score all: see ``train`` and ``score``.  Without both good
    and bad labels the model is constant: all good, or all bad."""
    return score(docs, train(docs, labels), threshold)
