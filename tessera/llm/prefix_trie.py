"""Prefix trie of rebuilt conversations, by a skeleton of splitter paths.

A conversation is a path: a digest of (role, text) and a word count for each turn.  Paths are dealt
into shards by ranges of (path, conv_id); the splitters between the ranges come from a sample, which
decides how even the shards are and nothing else.  The members of a node are neighbours in this order,
so a node that has members in two shards is a prefix of the splitter between them: the broadcast
splitter paths are a trie, the skeleton, that holds every node which any shard shares with another.
Each shard, sorted, finishes all its other nodes in one pass with a stack of the open ones; of skeleton
nodes it gives partial aggregates, which a reduction combines, subtrees by sums over prefixes.  Copies
of one path are parted by conv_id, so a group that holds a third of all conversations is many shards.

No row holds more than ``segment`` turns of a conversation.  A longer one is cut into segments, each of
which hangs at the node that the segments before it lead to.  A segment that no other conversation
shares is a chain whose nodes need no trie.  The others make tries of their own, the deepest first;
their totals go to the node they hang at.  So there are as many passes as the longest prefix that two
conversations share has segments.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.sequence import sequence_number
from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: conversations of one family share their first's turns
FAMILY = 20
SEGMENT = 256
#: rows of a shard, and sampled rows for each splitter
SHARD_ROWS, PER_SPLITTER = 100_000, 20
#: ids of a skeleton node that stand together in a row
IDS = 1 << 14
#: bytes of a turn's digest
D = 16
_ROOT = "0" * (2 * D)
_NONE = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, turn): the rebuilt turns, depth from 0, ``turn`` a struct of digest and words;
    for each conversation one more row with a null turn, so those without turns are there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * D)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.struct(digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("what"))
    placed = materialize(sequence_number(turns, ["conv_id"], ["turn", "what"], out="place"), "trie-turns")
    placed = placed.select("conv_id", (F.col("place") - 1).alias("place"), "what")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    most = 3
    heads = (placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("first"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "what"))).alias("head")))
    every = (placed.select("conv_id").distinct().withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
             .join(heads, "first", "left").withColumn("head", F.coalesce("head", F.expr("array()").cast(heads.schema["head"].dataType)))
             .select("conv_id", F.greatest(F.lit(0), F.col("h") - F.size("head")).alias("fewer"), F.slice("head", 1, F.greatest(F.col("h"), F.lit(0))).alias("head")))
    every = materialize(every, "trie-heads")
    taken = every.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), F.col("t.what").alias("what"))
    none = every.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(placed.schema["what"].dataType).alias("what"))
    # where the first of the family has fewer turns than are taken, later turns move up
    moved = every.where("fewer > 0").select("conv_id", "fewer")
    own = (placed.where(F.col("place") >= h).join(moved, "conv_id", "left")
           .select("conv_id", (F.col("place") - F.coalesce("fewer", F.lit(0))).alias("depth"), "what"))
    return own.unionByName(taken).unionByName(none)


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, k, at, next, path, words): the turns of a conversation, ``segment`` to a row; ``at`` is
    the node that segment k hangs at, ``next`` the one that the next hangs at (null: there is none)."""
    k = F.floor(F.col("depth") / segment).cast("int")
    of = F.sort_array(F.collect_list(F.when(F.col("what").isNotNull(), F.struct("depth", "what"))))
    rows = (turns.groupBy("conv_id", k.alias("k")).agg(of.alias("of"))
            .select("conv_id", "k", F.unhex(F.array_join("of.what.digest", "")).alias("path"), F.col("of.what.words").alias("words")))
    rows = materialize(rows, "trie-segments")
    none = F.lit(None).cast("string")
    if rows.where("k > 0").isEmpty():
        return rows.select("conv_id", "k", F.lit(_ROOT).alias("at"), none.alias("next"), "path", "words")
    long = rows.where("k > 0").select("conv_id").distinct()
    # a digest for each segment of long conversations; what leads to segment k is known by the first k of them
    chain = (rows.join(long, "conv_id", "left_semi").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("k", F.md5("path").alias("d")))).alias("chain")))
    lead = lambda n: F.when(n == 0, F.lit(_ROOT)).otherwise(F.md5(F.array_join(F.slice("ds", F.lit(1), n), "").cast("binary")))
    ats = (chain.select("conv_id", F.col("chain.d").alias("ds")).select("conv_id", "ds", F.posexplode("ds").alias("k", "d"))
           .select("conv_id", "k", lead(F.col("k")).alias("at"),
                   F.when(F.col("k") + 1 < F.size("ds"), lead(F.col("k") + 1)).alias("next")))
    return rows.join(ats, ["conv_id", "k"], "left").select("conv_id", "k", F.coalesce("at", F.lit(_ROOT)).alias("at"), "next", "path", "words")


def _splitters(rows: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """About ``shards`` - 1 keys (path, conv_id) that part the rows evenly, from a bounded sample."""
    if shards < 2:
        return []
    scale = 1 << 30
    bound = min(scale, math.ceil(scale * PER_SPLITTER * shards / max(1, n)))
    some = rows.where(F.pmod(F.xxhash64("conv_id", F.lit("split")), F.lit(scale)) < bound).select("path", "conv_id")
    keys = sorted((bytes(r.path), r.conv_id) for r in some.collect())
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


def _dealt(splitters):
    from bisect import bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = splitters.value
        for b in batches:
            shard = [bisect_right(keys, key) for key in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist())]
            yield b.append_column("shard", pa.array(shard, pa.int32()))
    return run


def _common(a: bytes, b: bytes) -> int:
    """Turns (digests) that two paths begin with alike."""
    n = min(len(a), len(b)) // D
    if a[:n * D] == b[:n * D]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo * D:(mid + 1) * D] == b[lo * D:(mid + 1) * D]:
            lo = mid + 1
        else:
            hi = mid
    return lo


class _Open:
    """A node on the stack: totals of its members and finished children so far."""
    __slots__ = ("first", "n", "kids", "leaves", "saved", "words", "ends", "next", "held", "ids", "piece")

    def __init__(self, words: int):
        self.first, self.n, self.kids, self.leaves, self.saved, self.words = None, 0, 0, 0, 0, words
        self.ends, self.next, self.held, self.ids, self.piece = None, None, [], [], 0


_NODE = [("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()),
         ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
         ("ends_sha256", pa.string()), ("next", pa.string()), ("key", pa.binary()), ("words", pa.int64()),
         ("shard", pa.int32()), ("piece", pa.int64())]
_NODE_SCHEMA = ("kind string, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, "
                "n_leaves long, saved_tokens long, ends_sha256 string, next string, key binary, words long, shard int, piece long")


class _Shard:
    """One pass over a shard's paths in order."""

    def __init__(self, shard: int, keys: list, base: int):
        self.shard, self.base = shard, base
        self.edges = [keys[i][0] for i in (shard - 1, shard) if 0 <= i < len(keys)]
        self.stack: list[_Open] = []
        self.path, self.skeleton = b"", 0
        self.out: list[tuple] = []

    def add(self, path: bytes, words: list, conv: int, next_: str | None, bonus: tuple | None) -> None:
        same = _common(path, self.path) if self.stack else 0
        self.close(same)
        depth = len(path) // D
        if path != self.path:
            # nodes up to here are prefixes of a splitter at this shard's edge; the top always counts as one
            self.skeleton = max([1, *(_common(path, e) for e in self.edges)])
            self.path = path
        for i in range(same, depth):
            self.stack.append(_Open(words[i - 1] if i else 0))
        node = self.stack[-1]
        node.n += 1
        node.first = conv if node.first is None else min(node.first, conv)
        if bonus:
            node.kids, node.leaves, node.saved = node.kids + bonus[0], node.leaves + bonus[1], node.saved + bonus[2]
        if next_ is not None:
            node.next = next_
        elif depth <= self.skeleton:
            node.ids.append(conv)
            if len(node.ids) >= IDS:
                self.flush(node, path)
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv)
        else:
            node.ends.update(b",%d" % conv)

    def flush(self, node: _Open, key: bytes) -> None:
        if node.ids:
            self.out.append(("ends", *[None] * 8, ",".join(map(str, node.ids)), None, key, None, self.shard, node.piece))
            node.ids, node.piece = [], node.piece + 1

    def close(self, keep: int) -> None:
        """Finish the open nodes below depth ``keep``."""
        while len(self.stack) > keep:
            i = len(self.stack) - 1
            node = self.stack.pop()
            parent = self.stack[-1] if self.stack else None
            depth, key = self.base + i, self.path[:(i + 1) * D]
            if parent is not None:
                parent.n += node.n
                parent.first = node.first if parent.first is None else min(parent.first, node.first)
            if i < self.skeleton:
                self.flush(node, key)
                self.out.append(("part", node.first, depth, None, None, node.n, node.kids, node.leaves, node.saved, None, node.next, key, node.words, None, None))
                rows = [("node", c, depth + 1, None, key, *rest) for c, rest in node.held]
            else:
                leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.words
                parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved
                sha = node.ends.hexdigest() if node.ends else _NONE
                # the parent's first member is known when the parent is finished
                parent.held.append((node.first, (node.n, node.kids, leaves, saved, sha, node.next, None, None, None, None)))
                rows = [("node", c, depth + 1, node.first, None, *rest) for c, rest in node.held]
            self.out += rows


def _nodes(splitters, base: int):
    """Rows of finished nodes, partial skeleton nodes and the ids that end at these."""
    schema = pa.schema(_NODE)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("shard", "path", "words", "conv_id", "next", "kids", "leaves", "saved")]
            for shard, path, words, conv, next_, kids, leaves, saved in zip(*cols):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.close(0)
                        yield batch(now.out)
                    now = _Shard(shard, splitters.value, base)
                now.add(path, words, conv, next_, None if kids is None else (kids, leaves, saved))
                if len(now.out) >= 20_000:
                    yield batch(now.out)
                    now.out = []
        if now is not None:
            now.close(0)
            yield batch(now.out)
    return run


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each skeleton node's ids, whose pieces stand after one another in order."""
    key, sha = None, None
    for b in batches:
        done = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "sha"])


def _skeleton(rows: DataFrame) -> DataFrame:
    """Skeleton nodes from their partial aggregates: (key, conv_id, depth, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, next)."""
    whole = (rows.where("kind = 'part'").groupBy("key")
             .agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
                  F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
                  F.max("words").alias("words"), F.max("next").alias("next")))
    whole = materialize(whole, "trie-skeleton")
    up = F.expr(f"substring(key, 1, length(key) - {D})")
    joints = whole.where(F.length("key") > D).groupBy(up.alias("key")).agg(F.count(F.lit(1)).alias("joints"))
    nodes = whole.join(joints, "key", "left").withColumn("n_children", F.col("kids") + F.coalesce("joints", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")))
    nodes = nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    # what lies below a node: its own and that of every skeleton node which begins with it
    above = F.transform(F.sequence(F.lit(1), (F.length("key") / D).cast("int")), lambda i: F.expr("key").substr(F.lit(1), i * D))
    below = (nodes.select(F.explode(above).alias("key"), "leaves", "saved").groupBy("key")
             .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    ids = (rows.where("kind = 'ends'").select("key", "shard", "piece", F.col("ends_sha256").alias("ids"))
           .repartition("key").sortWithinPartitions("key", "shard", "piece").mapInArrow(_hash_ids, "key binary, sha string"))
    return materialize(nodes.drop("leaves", "saved", "kids").join(below, "key").join(ids, "key", "left")
                       .select("key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
                               F.coalesce("sha", F.lit(_NONE)).alias("ends_sha256"), "next"), "trie-skeleton")


_OUT = ("conv_id", "depth", "parent_conv_id", "parent_at", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "next")


def _trie(rows: DataFrame, base: int, shards: int | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of the tries of rows (conv_id, at, next, path, words, kids, leaves, saved), whose
    tops are at depth ``base``; a top is a node only at depth 0, else it is the one that ``at`` names."""
    spark = rows.sparkSession
    rows = rows.withColumn("path", F.concat(F.unhex("at"), "path")).drop("at")
    n = rows.count()
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SHARD_ROWS))
    keys = spark.sparkContext.broadcast(_splitters(rows, shards, n))
    dealt = rows.mapInArrow(_dealt(keys), StructType([*rows.schema.fields, StructField("shard", IntegerType())]))
    ordered = dealt.repartitionById(len(keys.value) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = materialize(ordered.mapInArrow(_nodes(keys, base), _NODE_SCHEMA), "trie-nodes")
    frame = _skeleton(found)
    tops = frame.where(F.length("key") == D).withColumn("at", F.lower(F.hex("key")))
    parents = frame.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("top_conv"), F.length("key").alias("size"))
    at = F.when((F.col("size") == D) & F.lit(base > 0), F.lower(F.hex("parent_key")))
    joints = frame.where(F.length("key") > (D if base else 0)).withColumn("parent_key", F.expr(f"substring(key, 1, length(key) - {D})"))
    cols = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "next"]
    nodes = found.where("kind = 'node'").select("parent_key", "parent_conv_id", *cols).unionByName(
        joints.select("parent_key", F.lit(None).cast("long").alias("parent_conv_id"), *cols))
    nodes = nodes.join(parents, "parent_key", "left").withColumn("parent_at", at).withColumn(
        "parent_conv_id", F.when(F.col("parent_at").isNull(), F.coalesce("parent_conv_id", "top_conv")))
    return nodes.select(*_OUT), tops


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (``COLUMNS``), a row each.

    A conversation's turns stand in the order of ``turn`` (null first; rows that tie, in the order of
    their digests).  Conversation c is rebuilt from the first h turns of c - c % 20 and its own turns
    after its first h, h = crc32(c) % 4.  Turns are told apart by 128 bits of a SHA-256 of role and text.

    Null role or text: empty; rows without conv_id belong to no conversation; repeated rows are turns
    like others; a conversation that is rebuilt without turns is a member of the root alone; texts of
    any length are read whole; an empty table has no nodes, not even the root.  Other columns than
    conv_id, turn, role and text may have any name.  The list of a long conversation's segments
    (one digest for ``segment`` turns) stands in one row, and the ids that end at one node are hashed
    in order by one task, as their SHA-256 asks, from rows of up to IDS of them."""
    rows = _segments(rebuilt(conversations.select("conv_id", "turn", "role", "text")), segment)
    plain = [F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    if rows.where("k > 0").isEmpty():
        nodes, _ = _trie(rows.drop("k").select("*", *plain), 0, shards)
        return nodes.select(*COLUMNS)
    rows = materialize(rows, "trie-paths")
    members = rows.where("k > 0").groupBy("at").agg(F.count(F.lit(1)).alias("members"))
    rows = materialize(rows.join(members, "at", "left"), "trie-paths")
    alone = F.col("members") == 1
    shared = rows.where(F.col("members").isNull() | ~alone)
    # chains: from where a conversation shares with no other, one node for each turn
    lone = rows.where(alone)
    starts = lone.groupBy("conv_id").agg(F.min("k").alias("k"))
    i, end = F.col("i"), F.col("i") + 1 == F.size("words")
    last = end & F.col("next").isNull()
    chain = (lone.join(starts.withColumnRenamed("k", "from"), "conv_id")
             .select("conv_id", "k", "from", "at", "next", "words", F.posexplode("words").alias("i", "w"))
             .select("conv_id", (F.col("k") * F.lit(segment).cast("long") + i + 1).alias("depth"),
                     F.when((i > 0) | (F.col("k") > F.col("from")), F.col("conv_id")).alias("parent_conv_id"),
                     F.when((i == 0) & (F.col("k") == F.col("from")), F.col("at")).alias("parent_at"),
                     F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
                     F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                     F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NONE)).alias("ends_sha256"),
                     F.lit(None).cast("string").alias("next")))
    out = chain.select(*_OUT)
    # what hangs at the end of a segment goes with one conversation that leads there
    hang = starts.select("conv_id", (F.col("k") - 1).alias("k"), F.lit(1).cast("long").alias("kids"),
                         F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    for k in range(shared.agg(F.max("k")).first()[0], -1, -1):
        # one chain or one trie hangs at a node
        level = shared.where(F.col("k") == k).join(hang.where(F.col("k") == k).drop("k"), "conv_id", "left").drop("k", "members")
        nodes, tops = _trie(level, k * segment, shards)
        out = out.unionByName(nodes)
        hang = hang.unionByName(tops.select("conv_id", F.lit(k - 1).alias("k"), F.col("n_children").alias("kids"),
                                            F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    out = materialize(out, "trie-all")
    ends = out.where("next is not null").select(F.col("next").alias("parent_at"), F.col("conv_id").alias("end_conv"))
    return (out.join(ends, "parent_at", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "end_conv"))
            .select(*COLUMNS))


#: the query in DuckDB: a node is the JSON text of its turns; CRC-32 by a table made from its polynomial
SQL = r"""
WITH RECURSIVE crc_steps(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM crc_steps WHERE k = 8
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         json_array(coalesce(role, ''), coalesce(text, ''))::VARCHAR AS what, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), taken AS (
  SELECT c.conv_id, 0 AS own, t.place, t.what, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.what, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), paths AS (
  SELECT conv_id, list(what ORDER BY own, place) AS path, list(words ORDER BY own, place) AS words FROM taken GROUP BY conv_id
), full_paths AS (
  SELECT c.conv_id, coalesce(p.path, []) AS path, coalesce(p.words, []) AS words FROM convs c LEFT JOIN paths p USING (conv_id)
), members AS (
  SELECT conv_id, len(path) AS turns, d AS depth, path[1:d]::VARCHAR AS node, CASE WHEN d > 0 THEN path[1:d - 1]::VARCHAR END AS parent,
         CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM full_paths)
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CASE WHEN turns = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), kids AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.node = k.node
), below AS (
  SELECT a.depth, a.node, sum((c.n_children = 0)::INT)::BIGINT AS n_leaves, sum(c.saved)::BIGINT AS saved_tokens
  FROM (SELECT DISTINCT m.depth, m.node, x.depth AS to_depth, x.node AS to_node FROM members m JOIN members x ON m.conv_id = x.conv_id AND x.depth >= m.depth) a
  JOIN counted c ON c.depth = a.to_depth AND c.node = a.to_node GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON n.depth = b.depth AND n.node = b.node LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
"""
