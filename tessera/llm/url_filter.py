"""URL filter: explicit rules first, then naive Bayes over segmented host and path tokens.

Host labels are often words run together.  A unigram model, counted over the pages' texts and urls,
splits each label into the likeliest words (Viterbi); the words, and those of the path, are scored
by a multinomial naive Bayes.  Its classes are learned from the pages themselves: a page is a block
example when a word of the seed list is among its tokens, else an allow example, and the model
carries the judgement over to what occurs with such words.  Counts cover all pages and all words.
Tasks hold the VOCABULARY most frequent words (or url labels) at most; what is looked up of the
others is joined to the urls from written tables, so no word is dropped at any size.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

VOCABULARY = 50_000
MAX_WORD = 24
SALTS = 16
#: (verdict, rule): a host and a path prefix; fixed by the contract
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: words that mark a block example
SEEDS = ("adult", "bet", "betting", "casino", "escort", "gambling", "lottery", "malware", "phishing", "poker", "porn",
         "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")
#: how strongly the model must favour the block class (log odds)
MARGIN = 0.0
# one page more for the allow class would be needed to lose a word that only block pages have
SMOOTHING = 1.0

_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_TEXT_WORD = re.compile(r"[a-z]{1,%d}" % MAX_WORD)
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path): host after the first ``://`` up to ``/ ? #`` or the end, A-Z
    lower-cased; path up to ``? #`` or the end.  Null, or no ``://``: both empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    part = lambda i: F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i)
    return pages.select("page_id", "url", "html", F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                        part(2).alias("path"))


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` (the longest that fits, else null) and ``ruled`` (its verdict).  A rule fits
    its host and all subdomains, when the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        host, path = r[:r.index("/")], r[r.index("/"):]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruled", verdict)


def url_words(host: str, path: str) -> list[str]:
    """Raw tokens of a url: runs of letters (numbers become ``0``)."""
    return [x if x[0] > "9" else "0" for x in _TOKEN.findall(host + " " + path.lower())]


def split_words(token: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The likeliest split of a run of letters; an unknown word of n letters costs
    ``unknown + n * log 26``, so it is split only when the parts are known."""
    n = len(token)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - MAX_WORD), e):
            c = best[s] + cost.get(token[s:e], unknown + (e - s) * 3.2581)
            if c < best[e]:
                best[e], back[e] = c, s
    out = []
    while n:
        out.append(token[back[n]:n])
        n = back[n]
    return out[::-1]


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): counts of all words in all pages' visible texts and urls, written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            count: Counter = Counter()
            for host, path, html in zip(*(rb.column(i).to_pylist() for i in range(3))):
                count.update(x for x in url_words(host, path) if x != "0" and len(x) <= MAX_WORD)
                if html:
                    count.update(_TEXT_WORD.findall(_MARKUP.sub(" ", html).lower()))
            yield pa.record_batch({"word": pa.array(count.keys(), pa.string()), "n": pa.array(count.values(), pa.int64())})

    return materialize(pages.select("host", "path", "html").mapInArrow(work, "word string, n long")
                       .groupBy("word").agg(F.sum("n").alias("n")), "page-words")


class Segmenter:
    """Splits urls by a unigram model (a bounded table, shipped to the tasks)."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total)

    def __call__(self, host: str, path: str) -> list[str]:
        if "_one" not in self.__dict__:
            self._one = lru_cache(100_000)(lambda w: tuple(split_words(w, self.cost, self.unknown)))
        out: list[str] = []
        for x in url_words(host, path):
            out.extend((x,) if x == "0" else self._one(x))
        return out

    def __getstate__(self) -> dict:
        return {"cost": self.cost, "unknown": self.unknown}


_ROW = ["row", "page_id", "host", "path", "rule", "ruled"]
_ROW_TYPES = "row long, page_id long, host string, path string, rule string, ruled string"


def segmented(urls: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``urls`` with ``row``, a number of their own, and ``tokens``, the segmented host and path."""
    words = unigrams(urls)
    size = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    urls = urls.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), "host", "path", "rule", "ruled")
    if size["v"] <= vocabulary:
        segmenter = Segmenter({r["word"]: r["n"] for r in words.collect()})     # ``vocabulary`` rows at most
        return _tokens(urls, segmenter)
    rows = materialize(urls, "url-rows")
    labels = materialize(rows.select("host", "path").mapInArrow(_labels, "label string").groupBy("label").agg(F.count("*").alias("n")), "url-labels")
    splits = materialize(_splits(labels, words, size["n"]), "url-splits")
    # frequent labels go to every task, so the join has no hot key
    hot = {r["label"]: r["words"] for r in splits.orderBy(F.desc("n"), "label").limit(vocabulary).select("label", "words").collect()}
    cold = (rows.select("row", "host", "path").mapInArrow(_rare(lambda b: [set(url_words(h, p)) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())],
                                                                hot.keys() | {"0"}, "label"), "row long, label string")
            .join(splits, "label").groupBy("row").agg(F.collect_list(F.struct("label", "words")).alias("cold")))
    return _tokens(rows.join(cold, "row", "left"), hot)


def _tokens(rows: DataFrame, split) -> DataFrame:
    """Adds ``tokens`` by a Segmenter, or by the splits of frequent labels and the column ``cold``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            hosts, paths = rb.column(2).to_pylist(), rb.column(3).to_pylist()
            if isinstance(split, Segmenter):
                tokens = [split(h, p) for h, p in zip(hosts, paths)]
            else:
                tokens = []
                for h, p, cold in zip(hosts, paths, rb.column(6).to_pylist()):
                    own = {x["label"]: x["words"] for x in cold or ()}
                    tokens.append([w for x in url_words(h, p) for w in ((x,) if x == "0" else own[x] if x in own else split[x])])
            yield pa.RecordBatch.from_arrays([*rb.columns[:6], pa.array(tokens, pa.list_(pa.string()))], names=[*_ROW, "tokens"])

    rows = rows.select(*_ROW) if isinstance(split, Segmenter) else rows.select(*_ROW, "cold")
    return rows.mapInArrow(work, _ROW_TYPES + ", tokens array<string>")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        found = [x for h, p in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()) for x in url_words(h, p) if x != "0"]
        yield pa.record_batch({"label": pa.array(found, pa.string())})


def _rare(words_of, held, name: str):
    """For mapInArrow: (row, word) of the words of each row that are not in ``held``."""
    held = frozenset(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [(r, w) for r, words in zip(rb.column(0).to_pylist(), words_of(rb)) for w in words if w not in held]
            yield pa.record_batch({"row": pa.array([r for r, _ in found], pa.int64()), name: pa.array([w for _, w in found], pa.string())})
    return work


def _splits(labels: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(label, n, words): the likeliest split of each label by the whole unigram table."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            of: list[str] = []
            subs: list[str] = []
            for label in [*rb.column(0).to_pylist(), None]:
                if label:
                    some = {label[s:e] for s in range(len(label)) for e in range(s + 1, min(len(label), s + MAX_WORD) + 1)}
                    of += [label] * len(some)
                    subs += some
                if len(subs) > 50_000 or label is None:
                    yield pa.record_batch({"label": pa.array(of, pa.string()), "word": pa.array(subs, pa.string())})
                    of, subs = [], []

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for label, known in zip(rb.column(0).to_pylist(), rb.column(2).to_pylist()):
                s = Segmenter({x["word"]: x["c"] for x in known or ()}, total)
                out.append(split_words(label, s.cost, s.unknown))
            yield pa.RecordBatch.from_arrays([*rb.columns[:2], pa.array(out, pa.list_(pa.string()))], names=["label", "n", "words"])

    # short words are part of many labels: each word stands SALTS times, each label asks for one of them
    asked = labels.select("label").mapInArrow(parts, "label string, word string").withColumn("salt", F.pmod(F.xxhash64("label"), F.lit(SALTS)))
    salted = words.select("word", F.col("n").alias("c"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    known = asked.join(salted, ["word", "salt"]).groupBy("label").agg(F.collect_list(F.struct("word", "c")).alias("known"))
    return labels.join(known, "label", "left").select("label", "n", "known").mapInArrow(split, "label string, n long, words array<string>")


def train(rows: DataFrame, seeds=SEEDS) -> tuple[DataFrame | None, float]:
    """((word, n, odds): the log odds of all words, prior log odds) of a multinomial naive Bayes,
    block against allow; no table when one of the classes has no pages."""
    bad = F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in seeds]))
    one = rows.select(bad.alias("bad"), "tokens")
    pages = {r["bad"]: r["n"] for r in one.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if not pages.get(True) or not pages.get(False):
        return None, -math.inf if not pages.get(True) else math.inf
    counts = (one.select("bad", F.explode("tokens").alias("word")).groupBy("word")
              .agg(F.sum(F.col("bad").cast("long")).alias("b"), F.count("*").alias("n")))
    counts = materialize(counts, "url-words")
    total = counts.agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.count("*").alias("v")).first()
    nb = total["b"] + SMOOTHING * total["v"]
    na = total["n"] - total["b"] + SMOOTHING * total["v"]
    odds = F.log((F.col("b") + SMOOTHING) / nb) - F.log((F.col("n") - F.col("b") + SMOOTHING) / na)
    return counts.select("word", "n", odds.alias("odds")), math.log(pages[True] / pages[False])


def filter_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, margin: float = MARGIN,
                vocabulary: int = VOCABULARY) -> DataFrame:
    """(page_id, host, path, rule, verdict, tokens, log_odds), one row per row of ``pages``.

    verdict is the longest fitting rule's, else ``block`` where the naive Bayes log odds exceed
    ``margin``, else ``allow``.  ``vocabulary`` says how many words a task holds; results do not depend
    on it (but for the last digits of a sum).  A null url, or one without ``://``, has an empty host and path, no
    tokens, and is allowed unless most pages are block examples.  Null pages' texts count nothing;
    repeated rows are judged alike; other columns are ignored; an empty table gives no rows."""
    urls = ruled(parsed(pages), rules)
    rows = materialize(segmented(urls, vocabulary), "url-tokens")
    table, prior = train(rows, seeds)
    top = table.orderBy(F.desc("n"), "word").limit(vocabulary + 1).collect() if table is not None else []
    odds = {r["word"]: r["odds"] for r in top[:vocabulary]}
    if len(top) > vocabulary:
        # what is left is rare, so the join has no hot key
        rare = rows.select("row", "tokens").mapInArrow(_rare(lambda b: b.column(1).to_pylist(), odds, "word"), "row long, word string")
        rows = rows.join(rare.join(table, "word").groupBy("row").agg(F.sum("odds").alias("rest")), "row", "left")
    else:
        rows = rows.withColumn("rest", F.lit(0.0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            score = [prior + sum(odds.get(w, 0.0) for w in tokens) + (rest or 0.0) for tokens, rest in zip(rb.column(5).to_pylist(), rb.column(6).to_pylist())]
            verdict = [r or ("block" if s > margin else "allow") for r, s in zip(rb.column(4).to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], pa.array(verdict, pa.string()), rb.column(5), pa.array(score, pa.float64())],
                                             names=["page_id", "host", "path", "rule", "verdict", "tokens", "log_odds"])

    return rows.select(*_ROW[1:], "tokens", "rest").mapInArrow(
        work, "page_id long, host string, path string, rule string, verdict string, tokens array<string>, log_odds double")
