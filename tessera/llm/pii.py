"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

The patterns (email, ip, card, phone) run over whole texts.  A bidirectional LSTM over characters
with CRF transitions is trained in numpy from labelled spans: pattern matches in a bounded sample of
documents, also written in ways that the patterns do not take.  It reads overlapping windows around
every digit and every at sign, written in brackets or as a sign (a span of any kind holds one, so other text cannot matter); each
window is decoded, a span that a window's edge cuts is read again in a wide window, and the spans of all windows of a text are reconciled at once: the set without
overlaps that has the highest total score, next to the patterns' spans, which always stay.
"""
from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Possessive, and numbers only from a digit run's first digit (a match ends with a whole run), so that
# no run is read again from each of its characters.
_PATTERN = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++(@?)")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
WINDOW = 64
STRIDE = 32
#: spans up to this length are seen whole, with CONTEXT characters around them
LONGEST, CONTEXT = 144, 16
WIDE = 2 * (LONGEST + CONTEXT)
#: sample of documents the tagger is trained on, at most (smallest hashes of doc_id and text)
SAMPLE = 2_000
TRAIN_WINDOWS = 3_200
STEPS = 700
#: least mean probability of a span that the tagger adds
SURE = 0.75
HIDDEN, EMBED = 20, 10
_TAGS = 1 + 2 * len(KINDS)                        # O, then B and I of each kind
_ANCHOR = re.compile(r"[0-9@]|[\[(] ?[Aa][Tt] ?[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _holds(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))
    digits = re.sub("[^0-9]", "", s)
    return (16 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 8 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """Each run of name characters that an at sign and a domain follow; every run is read once."""
    out, at = [], 0
    if "@" not in text:
        return out
    while (name := _LOCAL.search(text, at)):
        at = name.end()
        if name[1] and (domain := _DOMAIN.match(text, at)):
            at = domain.end()
            out.append((name.start(), at))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass their check, in code points; the time
    grows with the length of the text, whatever is in it."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    if _ANCHOR.search(text):
        for kind in KINDS[1:]:
            out[kind] = [m.span() for m in _PATTERN[kind].finditer(text) if _holds(kind, m[0])]
    return out


# ---- the tagger ----
_CHARS = 128


def _codes(s: str) -> np.ndarray:
    """Character classes: ASCII as it is, any other letter 1, any other sign 2."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c < _CHARS, c, np.where(c < 0x250, 1, 2))


class Tagger:
    """Character BiLSTM with a CRF on top; weights are a dict of small arrays."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        n = lambda *s: r.standard_normal(s) * 0.3 / np.sqrt(s[0])
        self.w = {"emb": r.standard_normal((_CHARS, EMBED)) * 0.3, "out": n(2 * HIDDEN, _TAGS), "bias": np.zeros(_TAGS),
                  "trans": np.zeros((_TAGS, _TAGS)), "begin": np.zeros(_TAGS)}
        for d in "fb":
            self.w[f"x{d}"], self.w[f"h{d}"] = n(EMBED, 4 * HIDDEN), n(HIDDEN, 4 * HIDDEN)
            self.w[f"g{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.allowed = np.ones((_TAGS, _TAGS), bool)       # I of a kind only after its B or I
        for k in range(len(KINDS)):
            i = 2 + 2 * k
            self.allowed[:, i] = False
            self.allowed[[i - 1, i], i] = True

    def _lstm(self, e: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        b, t, _ = e.shape
        h = c = np.zeros((b, HIDDEN))
        pre = e @ self.w[f"x{d}"] + self.w[f"g{d}"]
        out, tape = np.zeros((b, t, HIDDEN)), []
        for i in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = pre[:, i] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            gi, gf, go = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            u = np.tanh(z[:, 3 * HIDDEN:])
            c0, h0 = c, h
            c = gf * c + gi * u
            tc = np.tanh(c)
            h = go * tc
            out[:, i] = h
            tape.append((i, gi, gf, go, u, c0, h0, tc))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.w["emb"][x]
        return np.concatenate([self._lstm(e, "f")[0], self._lstm(e, "b")[0]], 2) @ self.w["out"] + self.w["bias"]

    def _trans(self) -> np.ndarray:
        return np.where(self.allowed, self.w["trans"], -1e4)

    def _begin(self) -> np.ndarray:
        # a window may begin inside a span
        return self.w["begin"]

    def marginals(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log partition, tag probabilities, expected transitions) of each window."""
        b, t, k = em.shape
        tr = self._trans()
        a, z = np.zeros((t, b, k)), np.zeros((t, b, k))
        a[0] = em[:, 0] + self._begin()
        for i in range(1, t):
            m = a[i - 1].max(1, keepdims=True)
            a[i] = em[:, i] + m + np.log(np.exp(a[i - 1] - m) @ np.exp(tr) + 1e-30)
        for i in range(t - 2, -1, -1):
            v = z[i + 1] + em[:, i + 1]
            m = v.max(1, keepdims=True)
            z[i] = m + np.log(np.exp(v - m) @ np.exp(tr).T + 1e-30)
        m = a[-1].max(1)
        total = m + np.log(np.exp(a[-1] - m[:, None]).sum(1))
        p = np.exp(a + z - total[None, :, None]).transpose(1, 0, 2)
        pair = np.zeros((k, k))
        for i in range(1, t):
            pair += np.einsum("bi,bj->ij", np.exp(a[i - 1] - total[:, None]), np.exp(np.clip(em[:, i] + z[i], -500, 500)), optimize=True) * np.exp(tr) \
                if np.abs(total).max() < 300 else np.exp(a[i - 1][:, :, None] + tr[None] + (em[:, i] + z[i])[:, None, :] - total[:, None, None]).sum(0)
        return total, p, pair

    def decode(self, em: np.ndarray) -> np.ndarray:
        """Most likely tags (Viterbi)."""
        b, t, k = em.shape
        tr = self._trans()
        best, back = em[:, 0] + self._begin(), np.zeros((t, b, k), np.int8)
        for i in range(1, t):
            s = best[:, :, None] + tr[None]
            back[i] = s.argmax(1)
            best = s.max(1) + em[:, i]
        tags = np.zeros((b, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][np.arange(b), tags[:, i]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags ``y`` and its gradients."""
        b, t = x.shape
        e = self.w["emb"][x]
        hf, tf = self._lstm(e, "f")
        hb, tb = self._lstm(e, "b")
        h = np.concatenate([hf, hb], 2)
        em = h @ self.w["out"] + self.w["bias"]
        total, p, pair = self.marginals(em)
        one = np.eye(_TAGS)[y]
        gold = em[np.arange(b)[:, None], np.arange(t), y].sum(1) + self._trans()[y[:, :-1], y[:, 1:]].sum(1) + self._begin()[y[:, 0]]
        d_em = (p - one) / b
        g = {"begin": d_em[:, 0].sum(0), "bias": d_em.sum((0, 1)), "out": np.einsum("bth,btk->hk", h, d_em, optimize=True)}
        count = np.zeros((_TAGS, _TAGS))
        np.add.at(count, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        g["trans"] = np.where(self.allowed, (pair - count) / b, 0.0)
        d_h = d_em @ self.w["out"].T
        d_e = np.zeros_like(e)
        for d, tape, dh_out in (("f", tf, d_h[:, :, :HIDDEN]), ("b", tb, d_h[:, :, HIDDEN:])):
            gx, gh, gb = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"]), np.zeros_like(self.w[f"g{d}"])
            dh, dc = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
            for i, gi, gf, go, u, c0, h0, tc in reversed(tape):
                dh = dh + dh_out[:, i]
                dc = dc + dh * go * (1 - tc * tc)
                dz = np.concatenate([dc * u * gi * (1 - gi), dc * c0 * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - u * u)], 1)
                gx += e[:, i].T @ dz
                gh += h0.T @ dz
                gb += dz.sum(0)
                d_e[:, i] += dz @ self.w[f"x{d}"].T
                dh, dc = dz @ self.w[f"h{d}"].T, dc * gf
            g[f"x{d}"], g[f"h{d}"], g[f"g{d}"] = gx, gh, gb
        g["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(g["emb"], x.ravel(), d_e.reshape(-1, EMBED))
        return float((total - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 48, rate: float = 0.02) -> "Tagger":
        r = np.random.default_rng(9)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        self.losses = []
        for step in range(1, steps + 1):
            at = r.integers(0, len(x), min(batch, len(x)))
            loss, g = self.gradients(x[at], y[at])
            self.losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * (1 - 0.9 * step / steps)
            for k in self.w:
                a = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.w[k] = self.w[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def windows(text: str) -> list[int]:
    """Starts of the windows: every digit and at sign is inside one of them.  Spans that an edge
    cuts are left to wide_windows."""
    out: list[int] = []
    done = -1
    for m in _ANCHOR.finditer(text):
        if m.start() <= done:
            continue
        s = max(0, m.start() - STRIDE)
        s = max(s, out[-1] + STRIDE) if out and s < out[-1] + STRIDE else s
        out.append(s)
        done = s + STRIDE - 1 if s else STRIDE - 1
        done = max(done, m.start())
    return out


def wide_windows(cut: list[tuple[int, int]]) -> list[int]:
    """Starts of windows of WIDE characters; each piece of a cut span is in one that holds all spans
    of LONGEST characters around it, with context."""
    out: list[int] = []
    for a, b in sorted(cut, key=lambda c: c[1]):
        s = max(0, b - LONGEST - CONTEXT)
        if not out or a + LONGEST + CONTEXT > out[-1] + WIDE:
            out.append(s)
    return sorted(set(out))


def _padded(text: str, starts: list[int]) -> np.ndarray:
    c = np.concatenate([_codes(text), np.zeros(WINDOW, np.int64)])
    return c[np.asarray(starts, np.int64)[:, None] + np.arange(WINDOW)]


_AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?", re.I)
_DOT = re.compile(r"\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?", re.I)


def _plausible(kind: str, s: str) -> bool:
    """What any span of a kind holds; keeps the tagger from adding other numbers."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        s = _DOT.sub(".", _AT.sub("@", s))
        return bool(re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\s?\.\s?[^\s@]*[A-Za-z][^\s@]*", s))
    if kind == "ip":
        return len(re.findall("[0-9]+", s)) == 4 and _holds("ip", ".".join(re.findall("[0-9]+", s))) and not re.search("[A-Za-z+]", s)
    if re.search("[^0-9 ()+./-]", s):
        return False
    return (16 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else "+" in s and 8 <= len(digits) <= 15


def tagged(tagger: Tagger, texts: list[str], sure: float = SURE, batch: int = 256) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, score) of the reconciled spans of each text."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    cut: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, whole, *span in _decoded(tagger, texts, [(i, s) for i, t in enumerate(texts) for s in windows(t)], WINDOW, batch):
        if not whole:
            cut[i].append((span[0], span[1]))
        elif span[3] >= sure:
            found[i].append(tuple(span))
    # what a neighbour does not see whole is read again
    for i, part in enumerate(cut):
        cut[i] = [(a, b) for a, b in part if not any(x <= a and b <= y for x, y, *_ in found[i])]
    for i, whole, *span in _decoded(tagger, texts, [(i, s) for i, part in enumerate(cut) for s in wide_windows(part)], WIDE, batch // 4):
        if whole and span[3] >= sure and span[1] - span[0] <= LONGEST:
            found[i].append(tuple(span))
    return [reconcile(f) for f in found]


def _decoded(tagger: Tagger, texts: list[str], where: list[tuple[int, int]], width: int, batch: int) -> Iterator[tuple]:
    """(text, whole, start, end, kind, score) of the spans in windows (text, start) of ``width``;
    not whole: it touches an edge of the window, so it may be cut off."""
    coded: dict[int, np.ndarray] = {}
    for lo in range(0, len(where), batch):
        part = where[lo:lo + batch]
        for i, _ in part:
            if i not in coded:
                coded = {k: v for k, v in coded.items() if k >= part[0][0]}
                coded[i] = np.concatenate([_codes(texts[i]), np.zeros(width, np.int64)])
        em = tagger.emissions(np.stack([coded[i][s:s + width] for i, s in part]))
        tags, p = tagger.decode(em), tagger.marginals(em)[1]
        sure_of = np.take_along_axis(p, tags[:, :, None], 2)[:, :, 0]
        for row, (i, s) in enumerate(part):
            if not tags[row].any():
                continue
            y, at = tags[row], 0
            while at < width:
                # a window may begin inside a span
                if y[at] == 0 or (y[at] % 2 == 0 and at):
                    at += 1
                    continue
                end, inner = at + 1, y[at] + y[at] % 2
                while end < width and y[end] == inner:
                    end += 1
                whole = y[at] % 2 == 1 and (at > 0 or s == 0) and (end < width or s + width >= len(texts[i]))
                if s + end <= len(texts[i]) or not whole:
                    yield i, whole, s + at, min(s + end, len(texts[i])), (int(inner) - 2) // 2, float(sure_of[row, at:end].mean())
                at = end


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans without overlaps with the highest total of length times score (ties: earlier)."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2], -s[3]))
    ends = [s[1] for s in spans]
    best, take = [0.0], []
    for k, (a, b, _, p) in enumerate(spans):
        j = bisect.bisect_right(ends, a, 0, k)
        gain = best[j] + (b - a) * p
        take.append((gain > best[-1] + 1e-12, j))
        best.append(max(best[-1], gain))
    out, k = [], len(spans)
    while k:
        use, j = take[k - 1]
        if use:
            out.append(spans[k - 1])
            k = j
        else:
            k -= 1
    return out[::-1]


_LETTERS = "etaoinshrdlucmfpgwybvkxjqz"


def _name(r: np.random.Generator, longest: int) -> str:
    """A made-up label of letters and now and then a digit or hyphen."""
    n = int(r.integers(2, longest))
    out = "".join(_LETTERS[int(i)] for i in r.integers(0, len(_LETTERS), n))
    pick = int(r.integers(0, 6))
    return out + str(r.integers(0, 99)) if pick == 0 else f"{out[:n // 2]}-{out[n // 2:]}" if pick == 1 and n > 3 else out


def _address(r: np.random.Generator) -> str:
    """A made-up address, with names and labels of all lengths."""
    name = "._"[int(r.integers(0, 2))].join(_name(r, (8, 24)[int(r.integers(0, 2))]) for _ in range(int(r.integers(1, 3))))
    labels = [_name(r, (9, 28)[int(r.integers(0, 2))]) for _ in range(int(r.integers(1, 4)))]
    return f"{name}@{'.'.join(labels)}.{_name(r, 4)}"


def _digits(s: str, r: np.random.Generator) -> str:
    """``s`` with other digits."""
    return re.sub("[0-9]", lambda m: str(r.integers(0, 10)), s)


def _variants(kind: str, s: str, r: np.random.Generator) -> str:
    """Another way to write a span, in emails half the time of another address, in others of other digits."""
    pick = int(r.integers(0, 5))
    if kind == "email":
        if r.integers(0, 2):
            s = _address(r)
        name, _, host = s.rpartition("@")
        return (s, f"{name} @ {host}", s.upper(), f"{name} [at] {host}", f"{name} (at) {host.replace('.', ' (dot) ')}")[pick]
    if kind == "ip":
        if r.integers(0, 2):
            s = ".".join(str(r.integers(0, 256)) for _ in range(4))
        return (s, s.replace(".", " . "), s.replace(".", "-"), s.replace(".", "[.]"), s)[pick]
    if r.integers(0, 2):
        s = _digits(s, r)
    if kind == "phone":
        if r.integers(0, 2):
            s = f"+{r.integers(1, 1000)} {s.lstrip('+0123456789').lstrip()}"
        return (s, s.replace(" ", ""), re.sub("[() -]+", "/", s), re.sub("[() -]+", " / ", s), s)[pick]
    d = re.sub("[^0-9]", "", s)
    sign = (None, "/", ".", "  ", None)[pick]
    return s if sign is None else sign.join(d[i:i + 4] for i in range(0, len(d), 4))


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from the labelled spans of ``texts``; each window holds at least one anchor."""
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for text in texts:
        spans = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base_spans(text)[kind])
        marks, built, at = [], [], 0
        size = 0
        for a, b, k in spans:
            if a < at:
                continue
            s = _variants(KINDS[k], text[a:b], r)
            built += [text[at:a], s]
            size += a - at
            marks.append((size, size + len(s), k))
            size += len(s)
            at = b
        text = "".join([*built, text[at:]])
        y = np.zeros(len(text) + WINDOW, np.int64)
        for a, b, k in marks:
            y[a:b] = 2 + 2 * k
            y[a] = 1 + 2 * k
        starts = windows(text)[:40]
        if starts:
            shift = [max(0, s - int(r.integers(0, 16))) for s in starts]
            xs.append(_padded(text, shift))
            ys.append(y[np.asarray(shift)[:, None] + np.arange(WINDOW)])
        if sum(map(len, xs)) >= most:
            break
    if not xs:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    return np.concatenate(xs)[:most], np.concatenate(ys)[:most]


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger fitted on at most ``sample`` different documents with a digit or an at sign, those with
    the smallest hashes of doc_id and text; of each the windows' worth of text.  About 1.3 times as
    many rows come to the driver.  None if nothing is labelled."""
    near = (docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.col("text").rlike("[0-9@]")))
    n = near.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    if n > 1.3 * sample:      # rows under a bound of the hash, somewhat more than are asked for; copies count once
        near = near.where(F.col("h") < F.lit(int(-2 ** 63 + 1.3 * sample / n * 2 ** 64)))
    parts = F.slice(F.regexp_extract_all("text", F.lit(r"([^\n]{0,80}(?:[0-9@][^\n]{0,80}))"), F.lit(1)), 1, 8)
    rows = near.select("h", parts.alias("parts")).dropDuplicates(["h"]).collect()       # a few KB each
    rows = sorted(rows, key=lambda r: r["h"])[:sample]
    texts = [" ".join(r["parts"]) for r in rows]
    x, y = training_windows(texts)
    if not y.any():
        return None
    return Tagger().fit(x, y)


def all_spans(text: str, extra: list[tuple[int, int, int, float]]) -> tuple[dict, list[tuple[int, int, int]]]:
    """(base spans, all spans as (kind, start, end)): the tagger's join where they overlap no base
    span of any kind and are plausible."""
    base = base_spans(text)
    taken: list[list[int]] = []          # what base spans cover, as intervals apart
    for a, b in sorted(s for v in base.values() for s in v):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    out = [(k, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    for a, b, k, _ in extra:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        k0 = bisect.bisect_right(ends, a)
        if (k0 == len(taken) or b <= taken[k0][0]) and _plausible(KINDS[k], text[a:b]):
            out.append((k, a, b))
    return base, sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together, under the first one's kind) replaced by
    its kind in angle brackets."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, tagger: Tagger | None, redacted: bool = False, keep: list[str] = ()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans [, redacted] [, columns of ``keep``]),
    one row per row of ``docs``.  Counts and digest are of the base spans; ``spans`` lists all.

    Null texts are empty (no spans; ``redacted`` stays null); a null doc_id stays null; repeated rows
    each give a row; positions are code points; any length of text is read whole, in time that grows
    with it; other columns are ignored; an empty table gives no rows."""
    out = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    if redacted:
        out += ", redacted string"
    from pyspark.sql.types import StructType, _parse_datatype_string
    schema = StructType([*_parse_datatype_string(out).fields, *[docs.schema[c] for c in keep]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                rb = whole.slice(lo, 1000)
                texts = rb.column(1).to_pylist()
                extra: list = [[]] * len(texts)
                if tagger is not None:
                    at = [i for i, t in enumerate(texts) if t and _ANCHOR.search(t)]
                    extra = [[] for _ in texts]
                    for i, f in zip(at, tagged(tagger, [texts[i] for i in at])):
                        extra[i] = f
                counts, sha, spans, red = [], [], [], []
                for text, more in zip(texts, extra):
                    base, every = all_spans(text or "", more)
                    counts.append([len(base[k]) for k in KINDS])
                    sha.append(hashlib.sha256(written([(k, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]).encode()).hexdigest())
                    spans.append(written(every))
                    if redacted:
                        red.append(None if text is None else redact(text, every))
                n = np.array(counts, np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).cast(pa.int64()), *[pa.array(n[:, k]) for k in range(len(KINDS))], pa.array(sha, pa.string()), pa.array(spans, pa.string()),
                     *([pa.array(red, pa.string())] if redacted else []), *rb.columns[2:]], names=schema.names)

    return docs.select("doc_id", "text", *keep).mapInArrow(work, schema)
