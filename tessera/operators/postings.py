"""R1 by ranges of documents: exact top-k without a row for each (request, document).

The postings of an index are dealt to tasks by ranges of about RANGE documents.  A task has the terms
of a block of requests and goes through its ranges one after another: for each term of a range the
highest weight there bounds what it can add, so requests whose bounds together do not reach their
k-th best score so far skip the range; the others score its documents in NumPy.  A task gives at most
k rows for each request, so what is shuffled grows with tasks x k and not with the pairs.

Counts of matching documents (M1) come from the same rows: a bit for each document of a range, or-ed
over a request's terms.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: documents of a range; requests of a block; their terms altogether
RANGE = 1024
#: ranges that one task holds at most
TASK_RANGES = 4
BLOCK_REQUESTS, BLOCK_TERMS = 4096, 1 << 20
#: documents whose tokens are counted at a time
COUNT_ROWS = 1024
#: terms of a vocabulary that the tasks hold; a larger one is joined
HELD_TERMS = 1 << 17
SCORE_DIGITS = 4
#: sums in another order may differ by less than this
MARGIN = 2 * 10.0 ** -SCORE_DIGITS


def token_counts(vocabulary: list[str] | None = None):
    """(_id, dl, tokens) to rows (_id, dl, terms, tfs), one for each row; ``vocabulary``: the terms to
    keep.  Rows whose tokens are null have no terms."""
    known = None if vocabulary is None else pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, COUNT_ROWS):
                part = b.slice(at, COUNT_ROWS)
                tokens = part.column(2)
                code = tokens.flatten().dictionary_encode()
                terms = code.dictionary.cast(pa.string())
                n = max(1, len(terms))
                row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                pair = row * n + code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if known is not None:
                    pair = pair[pc.is_in(terms, known).to_numpy(zero_copy_only=False)[pair % n]] if len(terms) else pair
                pair, tf = np.unique(pair, return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) * n).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.ListArray.from_arrays(ends, terms.take(pa.array(pair % n))),
                    pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.float64)))], ["_id", "dl", "terms", "tfs"])
    return run


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    null = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(null, pc.fill_null(pc.not_equal(a, b), False)).to_numpy().astype(bool)


def _added_up(t: pa.Table) -> pa.Table:
    """(_id, dl, terms, tfs, n), those of one id and length side by side, to one row for each."""
    if t.num_rows < 2:
        return t
    new = np.concatenate([[True], _changes(t.column("_id")) | _changes(t.column("dl"))])
    if new.all():
        return t
    terms = t.column("terms").combine_chunks()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    tfs = pc.list_flatten(t.column("tfs")).to_numpy()
    of = (np.cumsum(new) - 1)[pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)]
    code = terms.flatten().dictionary_encode()
    m = max(1, len(code.dictionary))
    pair, at = np.unique(of * m + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    first = np.flatnonzero(new)
    ends = pa.array(np.searchsorted(pair, np.arange(len(first) + 1) * m).astype(np.int32))
    return pa.table({
        "_id": t.column("_id").take(pa.array(first)), "dl": t.column("dl").take(pa.array(first)),
        "terms": pa.ListArray.from_arrays(ends, code.dictionary.take(pa.array(pair % m))),
        "tfs": pa.ListArray.from_arrays(ends, pa.array(np.bincount(at, tfs, len(pair)))),
        "n": pa.array(np.add.reduceat(t.column("n").to_numpy(), first))}, schema=t.schema)


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, dl, terms, tfs) in the order of id and length to rows (_id, dl, term, tf): one for each
    term of an id and length, their counts added up, and one for each row with the term null."""
    def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, t.num_rows, COUNT_ROWS):
            part = t.slice(at, COUNT_ROWS).combine_chunks()
            terms, tfs = (pc.list_flatten(part.column(c)).combine_chunks() for c in ("terms", "tfs"))
            n = part.column("n").to_numpy()
            of = pa.array(np.concatenate([pc.list_parent_indices(part.column("terms")).to_numpy().astype(np.int64),
                                          np.repeat(np.arange(part.num_rows), n)]))
            yield from pa.table({
                "_id": part.column("_id").take(of), "dl": part.column("dl").take(of),
                "term": pa.chunked_array([terms, pa.nulls(int(n.sum()), pa.string())]),
                "tf": pa.chunked_array([tfs, pa.nulls(int(n.sum()), pa.float64())])}).combine_chunks().to_batches()
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]).append_column("n", pa.array(np.ones(b.num_rows, np.int64)))
        if not t.num_rows:
            continue
        # what belongs to the last row may go on in the next batch
        t = _added_up(t if rest is None else pa.concat_tables([rest, t]))
        rest = t.slice(t.num_rows - 1)
        yield from rows(t.slice(0, t.num_rows - 1))
    if rest is not None:
        yield from rows(rest)


def ranged(weights: DataFrame, n_docs: int, tasks: int | None = None) -> DataFrame:
    """Postings (term, _id, w) dealt by ranges: (range, term, _id, w), a range's rows together.  A range is a hash of the document, so all are of about one size."""
    spark = weights.sparkSession
    n = max(1, math.ceil(n_docs / RANGE))
    # the number of tasks follows the documents, so that what a task sorts does not grow with them
    tasks = tasks or min(n, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_RANGES)))
    rows = weights.where(F.col("_id").isNotNull()).select(F.pmod(F.xxhash64("_id"), F.lit(n)).alias("range"), "term", "_id", "w")
    return rows.repartition(tasks, "range").sortWithinPartitions("range")


class Best:
    """The best hits of each request so far, and the score that a further one must reach."""

    def __init__(self, ks: np.ndarray):
        self.ks, self.least = ks, np.full(len(ks), -np.inf)
        self.least[ks <= 0] = np.inf
        self.held: list[tuple] = []
        self.size = 0

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least[q]
        if keep.any():
            self.held.append((q[keep], score[keep], ids[keep]))
            self.size += int(keep.sum())
            if self.size > 2 * int(self.ks.sum()) + 20_000:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        q, score, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.ks[q] - 1
        self.least[q[last]] = score[last]
        keep = rank < self.ks[q]
        self.held = [(q[keep], score[keep], ids[keep])]
        self.size = int(keep.sum())
        return self.held[0]


class Scorer:
    """One block of requests over the ranges of a task.  ``asked``: for each term the requests with it."""

    def __init__(self, asked: dict[str, np.ndarray], ks: np.ndarray):
        self.asked, self.best = asked, Best(ks)
        self.scored = self.skipped = 0

    def range(self, terms: list[str], starts: np.ndarray, ids: np.ndarray, ws: np.ndarray) -> None:
        """Terms with the places where their postings begin (and one more), their documents and weights."""
        bound = np.zeros(len(self.best.ks))
        for t, lo, hi in zip(terms, starts, starts[1:]):
            bound[self.asked[t]] += ws[lo:hi].max()
        active = np.flatnonzero((bound > 0) & (bound + MARGIN >= self.best.least))
        self.skipped += int((bound > 0).sum()) - len(active)
        if not len(active):
            return
        self.scored += len(active)
        docs, at = np.unique(ids, return_inverse=True)
        place = np.full(len(bound), -1)
        place[active] = np.arange(len(active))
        scores = np.zeros((len(active), len(docs)))
        for t, lo, hi in zip(terms, starts, starts[1:]):
            rows = place[self.asked[t]]
            rows = rows[rows >= 0]
            if len(rows):
                scores[rows[:, None], at[lo:hi][None, :]] += ws[lo:hi]
        q, d = np.nonzero(scores)
        self.best.add(active[q], np.round(scores[q, d], SCORE_DIGITS), docs[d])


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(terms, starts, ids, weights) of each range by the order of its terms, from rows in the order of the ranges."""
    rest: pa.Table | None = None

    def split(table: pa.Table, last: bool):
        r = table.column("range").to_numpy()
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        edges = np.concatenate([[0], cuts, [len(r)]])
        for lo, hi in zip(edges[:-1] if last else edges[:-2], edges[1:] if last else edges[1:-1]):
            part = table.slice(lo, hi - lo)
            code = part.column("term").combine_chunks().dictionary_encode()
            if isinstance(code, pa.ChunkedArray):
                code = code.combine_chunks()
            by_term = pc.sort_indices(code.dictionary).to_numpy()
            c = np.argsort(by_term)[code.indices.to_numpy()]
            order = np.argsort(c, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(by_term)))])
            ids = part.column("_id").to_numpy()
            if ids.dtype == object:
                ids = ids.astype(str)
            yield code.dictionary.take(pa.array(by_term)).to_pylist(), starts, ids[order], part.column("w").to_numpy()[order]
        return None if last else table.slice(edges[-2])
    for b in batches:
        table = pa.Table.from_batches([b])
        rest = yield from split(table if rest is None else pa.concat_tables([rest, table]), False)
    if rest is not None and rest.num_rows:
        yield from split(rest, True)


def _blocks(requests: DataFrame) -> Iterator[list]:
    """Rows (query_id, terms, k) in blocks of bounded size; a block at a time is on the driver."""
    n, terms = requests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(1, math.ceil(2 * n / BLOCK_REQUESTS), math.ceil(2 * terms / BLOCK_TERMS))
    for i in range(parts):
        yield requests.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()


def _asked(block: list) -> dict[str, np.ndarray]:
    asked: dict[str, list] = {}
    for i, r in enumerate(block):
        for t in r.terms:
            asked.setdefault(t, []).append(i)
    return {t: np.array(v) for t, v in asked.items()}


def _over(weights, n_docs: int, requests: DataFrame, task, schema: str) -> DataFrame:
    """Union over blocks of requests of ``task(block, asked)`` on the ranged postings of their terms."""
    spark, out = requests.sparkSession, None
    for block in _blocks(requests):
        asked = _asked(block)
        if not asked:
            continue
        vocabulary = spark.createDataFrame([(t,) for t in asked], "term string")
        # bounded like the block, and each task has it anyway: the postings are not shuffled by their terms
        rows = ranged(weights(vocabulary) if callable(weights) else weights.join(F.broadcast(vocabulary), "term", "left_semi"), n_docs)
        part = rows.mapInArrow(task(block, asked), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def top_k(weights, n_docs: int, requests: DataFrame, id_type: str | None = None) -> DataFrame:
    """(query_id, _id, score, rank): the ``k`` best documents of each request (query_id, terms, k) by
    the sum of the weights (term, _id, w > 0) of its terms, ties to the smaller id.  ``weights`` may be
    a function that gives those of the terms (term) of a block of requests; then ``id_type`` is asked for."""
    q_type, id_type = _type(requests, "query_id"), id_type or _type(weights, "_id")

    def task(block: list, asked: dict):
        ks, qids = np.array([max(0, r.k or 0) for r in block]), [r.query_id for r in block]

        def run(batches):
            scorer = Scorer(asked, ks)
            for part in by_range(batches):
                scorer.range(*part)
            found = scorer.best.cut()
            if found is not None:
                q, score, ids = found
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q]), pa.array(ids.tolist()), pa.array(score)], ["query_id", "_id", "score"])
        return run
    hits = _over(weights, n_docs, requests, task, f"query_id {q_type}, _id {id_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_id")
    return (hits.withColumn("rank", F.row_number().over(w).cast("bigint")).join(requests.select("query_id", "k"), "query_id")
            .where("rank <= k").drop("k"))


def matching(weights: DataFrame, n_docs: int, requests: DataFrame) -> DataFrame:
    """(query_id, n_matches): documents that hold any term of each request (query_id, terms); requests
    without a match have no row."""
    q_type = _type(requests, "query_id")

    def task(block: list, asked: dict):
        qids = [r.query_id for r in block]

        def run(batches):
            n = np.zeros(len(qids), np.int64)
            for terms, starts, ids, _ in by_range(batches):
                docs, at = np.unique(ids, return_inverse=True)
                bits = np.zeros((len(qids), -(-len(docs) // 64)), np.uint64)
                word, bit = at // 64, np.uint64(1) << (at % 64).astype(np.uint64)
                for t, lo, hi in zip(terms, starts, starts[1:]):
                    mine = np.zeros(bits.shape[1], np.uint64)
                    np.bitwise_or.at(mine, word[lo:hi], bit[lo:hi])
                    bits[asked[t]] |= mine
                n += np.bitwise_count(bits).sum(1, dtype=np.int64)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in some]), pa.array(n[some])], ["query_id", "n"])
        return run
    counts = _over(weights, n_docs, requests, task, f"query_id {q_type}, n long")
    return counts.groupBy("query_id").agg(F.sum("n").alias("n_matches"))


def request_terms(requests: DataFrame, terms: Column, k: Column | None = None) -> DataFrame:
    """(query_id, terms, k) for :func:`top_k` and :func:`matching`."""
    return requests.select("query_id", F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))).alias("terms"),
                           (F.lit(0) if k is None else k).cast("int").alias("k"))
