"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted over whole texts.  For near pairs each word is a vector of letter counts; one
inserted or deleted code point changes one count by one, a replaced one changes two, so near words
have squared distance at most two and lengths at most one apart.  Words are blocked by length and,
within a length, by how many of their letters fall in each of CLASSES letter classes: an edit moves a
word to its own block, to one with a letter moved between two classes, or to one with a letter more.
Blocks are cut into tiles of at most TILE words, so a block that holds a third of all words is many
tiles, and each tile travels to the tiles it must meet, a row of words for each.  A task multiplies
the count matrices of two tiles in NumPy, keeps the cells with squared distance at most two and
verifies the edit by comparing heads and tails; only verified pairs leave the task.

Every word goes to the form among its near words with most occurrences, and forms are followed to
their root by pointer doubling: an edge at least doubles the occurrences, so chains are short.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: one run in so many is misspelt (a code point is deleted)
MISSPELT = 97
#: words of a tile, and signs of a tile (long words)
TILE, TILE_SIGNS = 1024, 1 << 20
#: cells of one product
CELLS = 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letter classes of about equal mass in Latin scripts; the last class is all other letters
CLASSES = ("e", "it", "na", "rho", "sdlu")

#: letter number of each Latin-1 byte: a-z, then U+00C0 to U+00FF
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[0xC0:] = np.arange(26, 90)
LETTERS = 90


def words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words and their occurrences over all texts, by the rules of ``variants``."""
    runs = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode_outer(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
            .where(F.length("run") >= MIN_LENGTH))
    # only A-Z have a lower case here; `lower` is the quick test that there is none of them
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    runs = runs.select("id", low.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % MISSPELT != 0, F.col("run")).otherwise(cut)
    return (runs.withColumn("at", at).select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT))


def _class_counts(word: str = "word") -> list:
    return [F.length(word) - F.length(F.translate(word, letters, "")) for letters in CLASSES]


def _tiles(vocabulary: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(tiles, blocks): tiles (block, t, len, words, ns) of one block's words run together, as all have
    one length; blocks (block, tiles).  ``block`` is the array of class counts, the rest's count last."""
    counts = _class_counts()
    rest = F.length("word") - sum(counts[1:], counts[0])
    rows = vocabulary.select("word", "n", F.array(*[c.cast("int") for c in counts], rest.cast("int")).alias("block"))
    size = F.greatest(F.ceil(F.col("words") / tile), F.ceil(F.col("words") * F.col("len") / TILE_SIGNS))
    blocks = (rows.groupBy("block").agg(F.count(F.lit(1)).alias("words"), F.first(F.length("word")).alias("len"))
              .select("block", size.cast("int").alias("tiles")))
    blocks = materialize(blocks, "spelling-blocks")
    rows = rows.join(blocks, "block").withColumn("t", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    tiles = (rows.groupBy("block", "t").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("of"))
             .select("block", "t", F.length(F.col("of")[0]["word"]).alias("len"),
                     F.array_join("of.word", "").alias("words"), F.col("of.n").alias("ns")))
    return materialize(tiles, "spelling-tiles"), blocks


def _targets() -> F.Column:
    """Blocks that a tile's words must meet besides their own: a letter moved from one class to a later
    one (the other direction is the other block's), or a letter more."""
    k = len(CLASSES) + 1
    moved = [tuple((x == j) - (x == i) for x in range(k)) for i in range(k) for j in range(i + 1, k)]
    longer = [tuple(int(x == j) for x in range(k)) for j in range(k)]
    return F.array(*[F.array(*[(F.col("block")[x] + d).cast("int") for x, d in enumerate(step)]) for step in moved + longer])


def _meetings(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (block, t, kind, len, words, ns): for each tile its own words (kind 0) and those of the
    tiles it must meet (kind 1), dealt by tile and in this order."""
    own = tiles.select("block", "t", F.lit(0).alias("kind"), "len", "words", "ns")
    count = blocks.select(F.col("block").alias("to"), "tiles")
    # of a block's own tiles, a later one goes to each earlier one
    inside = (tiles.where("t > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("to_t"))
              .select("block", F.col("to_t").alias("t"), F.lit(1).alias("kind"), "len", "words", "ns"))
    near = tiles.select("block", "t", F.explode(_targets()).alias("to")).where("array_min(to) >= 0")
    near = (near.join(count, "to").select("block", "t", "to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("to_t")))
    near = (near.join(tiles, ["block", "t"]).select(F.col("to").alias("block"), F.col("to_t").alias("t"),
                                                   F.lit(1).alias("kind"), "len", "words", "ns"))
    n = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * tiles.sparkSession.sparkContext.defaultParallelism)
    return own.unionByName(inside).unionByName(near).repartition(n, "block", "t").sortWithinPartitions("block", "t", "kind")


class _Tile:
    """Words of one length as a matrix of Latin-1 bytes, their letter counts and squared norms."""

    def __init__(self, length: int, words: str, ns: list):
        self.n = np.array(ns, np.int64)
        self.chars = np.frombuffer(words.encode("latin-1"), np.uint8).reshape(len(ns), length)
        rows = np.repeat(np.arange(len(ns)), length) * LETTERS
        counts = np.bincount(rows + _LETTER[self.chars.ravel()], minlength=len(ns) * LETTERS).reshape(len(ns), LETTERS)
        self.counts = counts.astype(np.float32 if length < 2000 else np.float64)
        self.norm = (self.counts * self.counts).sum(1)

    def words(self, rows: np.ndarray) -> list[str]:
        return [w.tobytes().decode("latin-1") for w in self.chars[rows]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of two byte matrices of equal width, or ``a`` wider by one: exactly one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if not b.shape[1]:
        return np.ones(len(a), bool)
    head, tail = a[:, :-1] == b, a[:, 1:] == b
    heads = np.where(head.all(1), b.shape[1], np.argmin(head, 1))
    back = tail[:, ::-1]
    tails = np.where(back.all(1), b.shape[1], np.argmin(back, 1))
    return heads + tails >= b.shape[1]


def near_rows(a: _Tile, b: _Tile) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words of two tiles; of a tile with itself each pair once."""
    left, right = [], []
    step = max(1, CELLS // max(1, len(b.n)))
    for lo in range(0, len(a.n), step):
        gram = a.counts[lo:lo + step] @ b.counts.T
        gram *= -2
        gram += a.norm[lo:lo + step, None]
        gram += b.norm[None, :]
        i, j = np.divmod(np.flatnonzero(gram.ravel() <= 2), max(1, len(b.n)))
        i += lo
        if a is b:
            i, j = i[i < j], j[i < j]
        # a chunk of candidates at a time: their letters are gathered for the comparison
        width = max(1, CELLS // max(1, a.chars.shape[1]))
        for k in range(0, len(i), width):
            x, y = i[k:k + width], j[k:k + width]
            ok = one_edit(a.chars[x], b.chars[y]) if a.chars.shape[1] >= b.chars.shape[1] else one_edit(b.chars[y], a.chars[x])
            left.append(x[ok])
            right.append(y[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_PAIRS = "word string, near string, near_n long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, in both directions, of tiles that stand after one another."""
    own, meet = None, {}

    def found(right: _Tile) -> Iterator[pa.RecordBatch]:
        i, j = near_rows(own, right)
        if len(i):
            a, b = own.words(i), right.words(j)
            yield pa.RecordBatch.from_arrays([pa.array(a + b), pa.array(b + a), pa.array(np.concatenate([right.n[j], own.n[i]]))],
                                             ["word", "near", "near_n"])

    def joined() -> Iterator[pa.RecordBatch]:
        for length, some in meet.items():
            if some:
                yield from found(_Tile(length, "".join(w for w, _ in some), [n for _, ns in some for n in ns]))
        meet.clear()

    held = 0
    for batch in batches:
        for kind, length, words, ns in zip(*(batch.column(c) for c in ("kind", "len", "words", "ns"))):
            kind, length, words, ns = kind.as_py(), length.as_py(), words.as_py(), ns.as_py()
            if kind == 0:
                if own is not None:
                    yield from joined()
                own, held = _Tile(length, words, ns), 0
                yield from found(own)
            else:
                # small tiles of one length are multiplied together
                meet.setdefault(length, []).append((words, ns))
                held += len(words)
                if held >= 4 * TILE * MIN_LENGTH:
                    yield from joined()
                    held = 0
    if own is not None:
        yield from joined()


def near_pairs(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) for every two of the words (word, n) that one edit parts, both ways."""
    tiles, blocks = _tiles(vocabulary, tile)
    return _meetings(tiles, blocks).mapInArrow(_pairs, _PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: pointers are doubled until each ends at a word without one."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of whole texts.

    Runs of letters A-Z, a-z and U+00C0 to U+00FF are lower-cased in A-Z; one run in 97, told by its
    document and itself, loses a code point.  Words are the distinct results of at least five code
    points and three occurrences.  ``form`` is the near word (one inserted, deleted or replaced code
    point) with most occurrences, the smallest of several, if it has at least twice the word's;
    ``root`` is where following forms ends, the word itself if it has none.

    Null and empty texts have no words; a null doc_id counts as an empty string before the colon;
    repeated rows count again; runs of any length are words; an empty table gives no rows.  Only
    ``doc_id`` and ``text`` are read, other columns may have any name."""
    vocabulary = materialize(words(docs.select("doc_id", "text")), "spelling-words")
    best = (near_pairs(vocabulary, tile).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    rows = vocabulary.join(best, "word", "left")
    form_n = -F.col("best.less")
    form = F.when(form_n >= 2 * F.col("n"), F.col("best.near"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"),
                       F.when(form.isNotNull(), form_n).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    out = rows.join(_roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: the query in DuckDB: near words by leaving out a code point each, CRC-32 by a table made from its polynomial
SQL = r"""
WITH RECURSIVE crc_steps(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM crc_steps WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL
), coded AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table
), words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM coded)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3
), cuts AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), left_out AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cuts
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM left_out a JOIN left_out b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM left_out a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM left_out a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, {'less': -near_n, 'near': encode(near)}) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chains(word, root, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.form = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word AND c.form IS NULL
"""
