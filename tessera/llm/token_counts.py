"""Token counts of whole texts; huge documents by overlapping chunks that are spliced again.

A text of at most ``chunk`` code points is encoded whole.  A longer one is cut into chunks that
overlap their neighbours by ``overlap`` code points on either side of a cut; the chunks are dealt to
all tasks and each is encoded with offsets.  Two neighbours are spliced at a position where both
encodings have a token boundary and no piece of the vocabulary fits across it: every merge product is
a piece, so nothing left or right of the position can ever join over it, whatever the context.  Where
two neighbours share no such position the document is tried again with wider overlaps (and longer
chunks), in the end whole.  So the counts are those of the library for the whole text.

The proof needs a BPE model without text normalisation (``identity``, no white-space removal); texts
of other models are encoded whole.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LIMIT = 4096
CHUNK = 1 << 14
OVERLAP = 512
#: overlaps and chunks grow by this factor where neighbours share no proven boundary
WIDEN = 8
#: bytes of chunks that a task gets
TASK_BYTES = 16 << 20
#: code points that a worker encodes in one call of the library
AT_ONCE = 1 << 20


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts and boundaries of one sentencepiece model."""

    _loaded: dict[str, "Counter"] = {}

    @classmethod
    def of(cls, path: str | None) -> "Counter":
        """The worker's own copy, loaded once; null: the default model."""
        path = path or default_model()
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        self.spliceable = (model.trainer_spec.model_type == pb.TrainerSpec.BPE and norm.escape_whitespaces
                           and norm.name == "identity" and not norm.precompiled_charsmap
                           and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
                           and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces))
        self.pieces = {p.piece for p in model.pieces if p.type == kinds.NORMAL}
        self.pairs = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.longest = max(map(len, self.pieces), default=1)
        # code points of each id; of the bytes of a code point beyond the vocabulary, the first has it
        self.width = np.array([self._width(p, kinds) for p in model.pieces], np.int64)
        # chunks from the inside of a text get no blank put before them
        norm.add_dummy_prefix = False
        self.inner = SentencePieceProcessor(model_proto=model.SerializeToString())

    @staticmethod
    def _width(p, kinds) -> int:
        if p.type == kinds.BYTE:
            return int(not 0x80 <= int(p.piece[3:5], 16) < 0xC0)
        return len(p.piece) if p.type == kinds.NORMAL else 1

    def counts(self, texts: Iterable[str]) -> list[int]:
        out: list[int] = []
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > AT_ONCE:
                out += map(len, self.sp.encode(some, num_threads=1))
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + [len(ids) for ids in self.sp.encode(some, num_threads=1)]

    def boundaries(self, text: str, first: bool) -> np.ndarray:
        """For each token of a chunk, the code points before its end.  ``first``: the chunk begins
        the document, whose blank in front is no code point of the text."""
        ids = (self.sp if first else self.inner).encode(text, num_threads=1)
        if not ids:
            return np.zeros(0, np.int64)
        return np.cumsum(self.width[np.array(ids)]) - int(first)

    def proven(self, text: str, p: int) -> bool:
        """No piece fits over position ``p`` of ``text`` (blanks written as the model writes them)."""
        if text[p - 1:p + 1] not in self.pairs:
            return True
        for i in range(max(0, p - self.longest + 1), p):
            for j in range(p + 1, min(len(text), i + self.longest) + 1):
                if text[i:j] in self.pieces:
                    return False
        return True

    def stable(self, text: str, ends: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int]]:
        """(positions, tokens before them): proven boundaries of a chunk at lo <= position < hi."""
        # a code point that became several bytes ends with the last of them
        last = np.append(ends[1:] != ends[:-1], True) if len(ends) else np.zeros(0, bool)
        at = np.flatnonzero(last & (ends >= lo) & (ends < hi))
        escaped = text[max(0, lo - self.longest):hi + self.longest].replace(" ", "▁")
        shift = max(0, lo - self.longest)
        at = [i for i in at.tolist() if self.proven(escaped, int(ends[i]) - shift)]
        return [int(ends[i]) for i in at], [i + 1 for i in at]


def _encode_whole(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model)
        for b in batches:
            n = counter.counts(t.as_py() for t in b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk rows of each text: ``start`` is the place of the chunk's first code point; ``cut_l`` and
    ``cut_r`` are the cuts on its left and right, around which its neighbours overlap with it.  One
    pass over the text, however long."""
    bodies = texts.select("row", F.expr(f"regexp_extract_all(text, '(?s).{{1,{chunk}}}', 0)").alias("bodies"))

    def lapped(body, i):
        left = F.when(i > 0, F.right(F.try_element_at("bodies", i), F.lit(overlap))).otherwise("")
        right = F.coalesce(F.left(F.try_element_at("bodies", i + 2), F.lit(overlap)), F.lit(""))
        return F.concat(left, body, right)
    rows = bodies.select("row", F.size("bodies").alias("n"), F.posexplode_outer(F.transform("bodies", lapped)).alias("k", "text"))
    k = F.col("k").cast("long")
    return rows.select("row", k.alias("k"), (F.col("k") == F.col("n") - 1).alias("last"),
                       F.greatest(F.lit(0).cast("long"), k * chunk - overlap).alias("start"),
                       (k * chunk).alias("cut_l"), ((k + 1) * chunk).alias("cut_r"), "text")


_ENDS = "row long, k long, last boolean, total long, lpos array<long>, lcnt array<long>, rpos array<long>, rcnt array<long>"


def _boundaries(model: str | None, overlap: int):
    """For each chunk its tokens and, around either cut, its proven boundaries with the tokens before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model)
        edge = counter.longest
        for b in batches:
            out = []
            for r in b.to_pylist():
                ends = counter.boundaries(r["text"], r["k"] == 0)
                row = {"row": r["row"], "k": r["k"], "last": r["last"], "total": len(ends)}
                for side, cut, none in (("l", r["cut_l"], r["k"] == 0), ("r", r["cut_r"], r["last"])):
                    # both neighbours know the text as far as `overlap` beyond the cut
                    lo, hi = cut - overlap + edge - r["start"], cut + overlap - edge - r["start"]
                    hi = min(hi, len(r["text"]))
                    pos, cnt = ([], []) if none or hi <= lo else counter.stable(r["text"], ends, lo, hi)
                    row[f"{side}pos"], row[f"{side}cnt"] = [p + r["start"] for p in pos], cnt
                out.append(row)
            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("row", long), ("k", long), ("last", pa.bool_()), ("total", long), ("lpos", longs), ("lcnt", longs), ("rpos", longs), ("rcnt", longs)]))
    return run


def _spliced(texts: DataFrame, model: str | None, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of chunked texts; null where two neighbours share no proven boundary."""
    spark = texts.sparkSession
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    chunks = _cut(texts, chunk, overlap).repartition(tasks, "row", "k")
    ends = materialize(chunks.mapInArrow(_boundaries(model, overlap), _ENDS), "token-chunks")
    left = ends.where("not last").select("row", (F.col("k") + 1).alias("k"), "rpos", "rcnt")
    right = ends.select("row", "k", "last", "total", "lpos", "lcnt")
    pos = F.try_element_at(F.array_intersect("rpos", "lpos"), F.lit(1))
    both = right.join(left, ["row", "k"], "left").withColumn("p", pos)
    before = F.expr("element_at(rcnt, int(array_position(rpos, p)))")
    after = F.expr("element_at(lcnt, int(array_position(lpos, p)))")
    # the tokens of a document: all of the last chunk, and at each splice those that the left
    # neighbour has before it less those that the right one has
    part = (F.when(F.col("k") == 0, F.lit(0).cast("long")).when(F.col("p").isNotNull(), before - after)
            + F.when(F.col("last"), F.col("total")).otherwise(F.lit(0).cast("long")))
    return both.select("row", part.alias("part")).groupBy("row").agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``n_tokens`` is what the model of sentencepiece at the path ``model`` (on every machine; null: the
    public 32k one) gives for the whole text, without begin and end signs; strings of special tokens
    are ordinary text.  Null text: empty, 0 tokens; null or repeated doc_id: a row like any other, so
    repeated rows come back as often as they stand; a text of one sign or blanks only: as the library
    has it; very long texts are cut and spliced as the module says; empty table: no rows.  Only
    ``doc_id`` and ``text`` are read, other columns may have any name."""
    if overlap <= 0 or chunk <= 2 * overlap:
        raise ValueError("chunk must be more than twice the overlap")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counter = Counter.of(model)
    # the margins in which a boundary is proven lie inside the overlap
    overlap = max(overlap, 4 * counter.longest)
    chunk = max(chunk, 4 * overlap)
    huge = F.length("text") > (chunk if counter.spliceable else (1 << 31) - 1)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    done = rows.where(~huge).mapInArrow(_encode_whole(model), schema)
    left = materialize(rows.where(huge).withColumn("row", F.monotonically_increasing_id()), "token-huge")
    texts = left
    while not texts.isEmpty():
        found = materialize(_spliced(texts, model, chunk, overlap), "token-spliced")
        good = found.where("n_tokens is not null")
        done = done.unionByName(left.select("row", "doc_id", "n_bytes").join(good, "row").drop("row"))
        texts = left.join(found.where("n_tokens is null"), "row", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
