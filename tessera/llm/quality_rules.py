"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for
each failed rule.  A policy is a named set of rules: applying one, or another version of it, is one
bitwise test of the stored mask, and ablations are bitwise aggregates of the ledger.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

#: measurements of the ledger, all long
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")

#: rule -> SQL condition under which a document fails it; the position is the rule's bit
RULES = {
    "too_short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "words_too_short": "word_chars < 2 * n_words",
    "words_too_long": "word_chars > 15 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "few_alphabetic": "10 * n_alpha_words < 7 * n_words",
}
#: versioned policies: the rules whose failure drops a document
POLICIES = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbols"),
    "v2": tuple(RULES),
}
POLICY = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def _prefix(mask: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c


def measure(t: tn.Texts) -> dict[str, np.ndarray]:
    """The measurements of each text of ``t``."""
    starts, ends, words = tn.word_spans(t)
    buf, out = t.buf, {"n_words": words}
    chars = _prefix((buf & 0xC0) != 0x80)
    out["word_chars"] = tn.sums_by_text(chars[ends] - chars[starts], words)
    alpha = _prefix(_ALPHA[buf])
    out["n_alpha_words"] = tn.sums_by_text(alpha[ends] > alpha[starts], words)
    symbols = _prefix(_SYMBOL[buf])
    out["n_symbols"] = symbols[t.offs[1:]] - symbols[t.offs[:-1]]
    h = tn.SpanHash(buf)
    salt = tn.mix64(np.arange(1, t.n + 1, dtype=np.uint64))
    # lines with a word: text starts and the bytes after \n up to the next end
    newline = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([t.offs[:-1], newline + 1]))
    line_text = np.searchsorted(t.offs, line_start, "right") - 1
    line_text = np.minimum(line_text, t.n - 1)
    line_end = np.append(line_start[1:], t.offs[-1])
    ends_nl = (line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 10) if len(buf) else np.zeros(len(line_start), bool)
    line_end = line_end - ends_nl
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    out["n_lines"] = np.bincount(line_text, minlength=t.n)
    key = h(line_start, line_end) ^ salt[line_text]
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order[1:]] == key[order[:-1]]]
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=t.n)
    # words inside a three-word window that the text repeats
    text = np.repeat(np.arange(t.n), words)
    w = tn.windows(h(starts, ends), 3)
    within = text[:-2] == text[2:] if len(text) > 2 else np.zeros(0, bool)
    twice = np.zeros(len(text), bool)
    twice[:len(w)][within] = tn.repeated(w[within] ^ salt[text[:len(w)][within]])
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    out["n_repeat_words"] = tn.sums_by_text(covered, words)
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs`` (whole texts, no shuffle): ``doc_id``, the measurements and
    ``failed`` (long), with bit i set when rule i of RULES fails.

    A null or empty text has no words and fails ``too_short``; a null doc_id stays null; repeated
    rows give repeated ledger rows; other columns of ``docs`` are not read; an empty table gives
    an empty ledger.  Any length of text is measured whole, in one pass of numpy over its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for t in tn.chunks(rb.column(1)):
                m = measure(t)
                yield pa.record_batch([rb.column(0).slice(t.lo, t.n).cast(pa.int64())]
                                      + [pa.array(m[k].astype(np.int64)) for k in MEASURES],
                                      names=["doc_id", *MEASURES])

    rows = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        work, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"if({cond}, {1 << i}L, 0L)" for i, cond in enumerate(RULES.values()))
    return rows.withColumn("failed", F.expr(bits))


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def apply_policy(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed (one bitwise test)."""
    return led.withColumn("kept", F.expr(f"(failed & {policy_mask(policy)}L) = 0"))


def ablations(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it drops
    (kept if the rule were left out), from one aggregate over the masks."""
    full = policy_mask(policy)
    masks = led.groupBy(F.expr(f"failed & {full}L").alias("m")).agg(F.count("*").alias("n"))
    rules = ", ".join(f"struct('{r}' as rule, {1 << i}L as bit)"
                      for i, r in enumerate(RULES) if full >> i & 1)
    return (masks.select("m", "n", F.expr(f"inline(array({rules}))"))
            .groupBy("rule").agg(F.sum(F.expr("if(m & bit != 0, n, 0L)")).alias("n_failed"),
                                 F.sum(F.expr("if(m = bit, n, 0L)")).alias("n_only"),
                                 F.sum("n").alias("n_docs")))
