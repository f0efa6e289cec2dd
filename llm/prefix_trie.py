"""The trie of conversations' common beginnings, by time-forward processing."""

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mandigrid.session import materialise

# Turns in a shard of conversations, and shards that are joined into one a level up.
SHARD_TURNS, FAN = 250_000, 32
# Messages that a queue holds as a heap; more wait in sorted, compressed runs.
HEAP_MESSAGES = 50_000
# Conversation ids in one cell of those that end at a node.
SEGMENT_IDS = 1_000
# Rows that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


class Messages:
    """A priority queue of messages (time, and whole numbers). When its heap is full the later
    half is sorted, compressed and put aside as a run; runs come back a block at a time."""

    BLOCK = 1_024

    def __init__(self, width: int):
        self.width, self.heap = width, []
        self.runs: list[Iterator[list[tuple]]] = []
        self.ahead: list[tuple[tuple, int]] = []  # first message of each run's block, and the run
        self.blocks: list[list[tuple]] = []

    def push(self, message: tuple) -> None:
        heappush(self.heap, message)
        if len(self.heap) > HEAP_MESSAGES:
            self.heap.sort()
            half = len(self.heap) // 2
            late, self.heap = self.heap[half:], self.heap[:half]  # sorted lists are heaps
            self._put_aside(late)

    def _put_aside(self, messages: list[tuple]) -> None:
        packed = []
        for at in range(0, len(messages), self.BLOCK):
            raw = np.array(messages[at:at + self.BLOCK], np.int64).tobytes()
            packed.append((len(raw), pa.compress(raw, codec="zstd", asbytes=True)))

        def read():
            for size, data in packed:
                raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
                yield [tuple(row) for row in np.frombuffer(raw, np.int64).reshape(-1, self.width).tolist()][::-1]

        self.runs.append(read())
        self.blocks.append([])
        self._refill(len(self.runs) - 1)

    def _refill(self, run: int) -> None:
        if not self.blocks[run]:
            self.blocks[run] = next(self.runs[run], [])
        if self.blocks[run]:
            heappush(self.ahead, (self.blocks[run][-1], run))

    def pop_at(self, time: int) -> Iterator[tuple]:
        """The messages for ``time``, the earliest that is left."""
        while True:
            if self.heap and self.heap[0][0] == time:
                yield heappop(self.heap)
            elif self.ahead and self.ahead[0][0][0] == time:
                _, run = heappop(self.ahead)
                yield self.blocks[run].pop()
                self._refill(run)
            else:
                return


class Node:
    """A node as far as it is known: its conversations that end here or below closed children."""

    __slots__ = ("above", "depth", "size", "n", "least", "children", "leaves", "saved", "open", "key", "ends")

    def __init__(self, above: int, depth: int, size: int):
        self.above, self.depth, self.size, self.open, self.key = above, depth, size, False, None
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends = None, None

    def take(self, n, least, children, leaves, saved) -> None:
        self.n += n
        self.least = least if self.least is None or least is not None and least < self.least else self.least
        self.children += children
        self.leaves += leaves
        self.saved += saved


def climb(nodes: list[Node]) -> list[int]:
    """Pass the totals of closed nodes up, the deepest level first; open ones keep theirs.

    Nodes are taken in reverse level order. A node that is done sends its totals to its parent's
    time, which is later. Returns the order.
    """
    order = sorted(range(len(nodes)), key=lambda i: -nodes[i].depth)
    time = [0] * len(nodes)
    for t, i in enumerate(order):
        time[i] = t
    queue = Messages(5)
    for t, i in enumerate(order):
        node = nodes[i]
        for _, n, least, leaves, saved in queue.pop_at(t):
            node.take(n, least, 1, leaves, saved)
        if node.open:
            continue
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size
        if node.above >= 0:
            queue.push((time[node.above], node.n, node.least, node.leaves, node.saved))
    return order


def rebuilt(conversations: DataFrame, heads=9, family=5) -> DataFrame:
    """conv_id, path (digest of each turn's role and text) and sizes (bytes of each text).

    Conversation c begins with the first h turns of conversation c - c % ``family``, h =
    crc32(c) % ``heads``, and goes on with its own turns after its first h. The remainder has the
    sign of c.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.collect_list("t").alias("t"))
    own = own.select(F.col("conv_id").cast("long"), F.transform(F.array_sort("t", lambda a, b: _compare(a, b)), lambda t: F.struct(
        F.unhex(F.substring(t["digest"], 1, 32)).alias("digest"), t["size"].alias("size"))).alias("own"))
    own = materialise(own, "trie-own").withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("first"))
    turns = own.join(first, "base", "left").withColumn("h", head.cast("int"))
    none = F.expr("slice(own, 1, 0)")
    turns = turns.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")),
                                             F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns"))
    return turns.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.size").alias("sizes"))


def _compare(a, b):
    """By turn, null first, then by digest."""
    def by(x, y, otherwise):
        return F.when(x < y, -1).when(x > y, 1).otherwise(otherwise)

    digests = by(a["digest"], b["digest"], F.lit(0))
    x, y = a["turn"], b["turn"]
    return F.when(x.isNull() & y.isNull(), digests).when(x.isNull(), -1).when(y.isNull(), 1).otherwise(by(x, y, digests))


_LONG, _BOOL = T.LongType(), T.BooleanType()
ROWS = T.StructType([T.StructField(name, kind) for name, kind in (
    ("kind", T.StringType()), ("shard", _LONG), ("first", _BOOL), ("last", _BOOL), ("key", T.BinaryType()), ("above", T.BinaryType()),
    ("depth", _LONG), ("size", _LONG), ("conv_id", _LONG), ("parent_conv_id", _LONG), ("n_convs", _LONG), ("n_children", _LONG),
    ("n_leaves", _LONG), ("saved_tokens", _LONG), ("ends_sha256", T.StringType()), ("ids", T.ArrayType(_LONG)))])


def keys_of(path: list[bytes]) -> list[bytes]:
    """A key for each beginning of ``path``, the empty one first."""
    keys = [b"root"]
    for digest in path:
        keys.append(hashlib.blake2b(keys[-1] + digest, digest_size=16).digest())
    return keys


def _batches(rows: Iterator[tuple], size=2_000):
    arrow, block = to_arrow_schema(ROWS), []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), arrow)], schema=arrow)

    for row in rows:
        block.append(row)
        if len(block) == size:
            yield made()
            block = []
    if block:
        yield made()


def told(ids: list[int] | None) -> str | None:
    """Digest of the ids of the conversations that end at a node."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else None


def finished(nodes: list[Node], order: list[int], shard: int, flags: dict[int, tuple[bool, bool]]) -> Iterator[tuple]:
    """Rows of closed nodes, and of open ones as far as they are known.

    A closed node below an open one names its parent by key; its ``conv_id`` is found when it is.
    """
    for i in order:
        node, parent = nodes[i], nodes[nodes[i].above] if nodes[i].above >= 0 else None
        up = parent.key if parent is not None and parent.open else None
        totals = (node.n, node.children, node.leaves, node.saved)
        if node.open:
            yield ("open", shard, *flags[i], node.key, up, node.depth, node.size, node.least, None, *totals, None, None)
        else:
            known = parent.least if parent is not None and up is None else None
            yield ("node", None, None, None, node.key, up, node.depth, None, node.least, known, *totals, node.ends, None)


def in_shard(rows: Iterator[tuple[int, list[bytes], list[int]]], shard: int) -> Iterator[tuple]:
    """The nodes of a shard: conversations in the order of their paths and then ids.

    Only the beginnings of the first and of the last path can go on in other shards; these are
    the open ones, and the ids of conversations that end there are rows of their own.
    """
    nodes, chain, path, firsts, first_path = [Node(-1, 0, 0)], [0], [], None, []
    for conv_id, own, sizes in rows:
        same = 0
        while same < min(len(path), len(own)) and path[same] == own[same]:
            same += 1
        for i in chain[same + 1:]:  # nothing more comes below these
            if i not in firsts:
                nodes[i].ends = told(nodes[i].ends)
        del chain[same + 1:]
        for depth in range(same, len(own)):
            nodes.append(Node(chain[-1], depth + 1, sizes[depth]))
            chain.append(len(nodes) - 1)
        path, end = own, nodes[chain[-1]]
        if firsts is None:
            firsts, first_path = dict.fromkeys(chain), own
        end.take(1, conv_id, 0, 0, 0)
        end.ends = end.ends or []
        end.ends.append(conv_id)
    if firsts is None:
        return
    flags, ids = {}, {}
    for of_first, at, keys in ((True, firsts, keys_of(first_path)), (False, chain, keys_of(path))):
        for i, key in zip(at, keys):
            was, node = flags.get(i, (False, False)), nodes[i]
            flags[i] = (True, was[1]) if of_first else (was[0], True)
            node.open, node.key, ids[key] = True, key, ids.get(key) or node.ends or []
            node.ends = None
    yield from finished(nodes, climb(nodes), shard, flags)
    for key, own in ids.items():
        for at in range(0, len(own), SEGMENT_IDS):
            yield ("ids", shard, None, None, key, None, None, None, own[at], *[None] * 6, own[at:at + SEGMENT_IDS])


def join_shards(rows: list[dict], shard: int, last: bool) -> Iterator[tuple]:
    """The open nodes of neighbouring shards put together. Those are still open that the first
    shard's first path or the last one's last path begins with; at the ``last`` level none is."""
    low, high = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    place, nodes, flags, above = {}, [], {}, []
    for r in sorted(rows, key=lambda r: r["depth"]):
        i = place.setdefault(r["key"], len(nodes))
        if i == len(nodes):
            nodes.append(Node(place[r["above"]] if r["depth"] else -1, r["depth"], r["size"]))
            nodes[i].key = r["key"]
        nodes[i].take(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
        was = flags.get(i, (False, False))
        flags[i] = (was[0] or r["first"] and r["shard"] == low, was[1] or r["last"] and r["shard"] == high)
        nodes[i].open = not last and any(flags[i])
    yield from finished(nodes, climb(nodes), shard, flags)


def digests(ids: DataFrame) -> DataFrame:
    """key and ends_sha256 of the ids in rows (key, shard, conv_id, ids), hashed as they stream by."""
    arrow = pa.schema([("key", pa.binary()), ("digest", pa.string())])

    def run(batches):
        key, ends = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ends.hexdigest()])], schema=arrow)
        for batch in batches:
            for k, own in zip(*batch.columns):
                text = ",".join(map(str, own.as_py()))
                if k.as_py() != key:
                    if ends:
                        yield done()
                    key, ends = k.as_py(), hashlib.sha256(text.encode())
                else:
                    ends.update(f",{text}".encode())
        if ends:
            yield done()

    rows = ids.repartition("key").sortWithinPartitions("key", "shard", "conv_id")
    return rows.select("key", "ids").mapInArrow(run, "key binary, digest string")


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefix_trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of
    each node of the trie of ``paths`` (conv_id, path, sizes; ids are unique).

    Conversations are sorted by path and id and dealt to shards in that order. In a shard nodes
    are taken in reverse level order and pass their totals to their parents through a priority
    queue. Only beginnings of a shard's first and last path may have members elsewhere: these
    are put together, FAN shards at a time, by the same procedure, until there is one left. A
    path has to fit into memory, a node's conversations and children needn't: a first turn that
    all share is one open node in each shard. An empty table has no nodes.
    """
    paths = materialise(paths, "trie-paths")
    turns = paths.agg(F.sum(F.size("path") + F.lit(1)).alias("n")).first()["n"] or 0
    shards = max(1, -(-turns // SHARD_TURNS))
    dealt = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def build(batches):
        rows = ((i.as_py(), p.as_py(), s.as_py()) for batch in batches for i, p, s in zip(*batch.columns))
        yield from _batches(in_shard(rows, TaskContext.get().partitionId()))

    rows = materialise(dealt.select("conv_id", "path", "sizes").mapInArrow(build, ROWS), "trie-shards")
    found, opened = [rows.where("kind = 'node'")], rows.where("kind = 'open'")
    ends = digests(rows.where("kind = 'ids'").select("key", "shard", "conv_id", "ids"))
    shards = (opened.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        groups = -(-shards // FAN)
        last = groups == 1

        def climb_on(group, table):
            made = list(_batches(join_shards(table.to_pylist(), group[0].as_py(), last)))
            return pa.Table.from_batches(made, to_arrow_schema(ROWS))

        up = opened.withColumn("group", F.floor(F.col("shard") / FAN)).groupBy("group").applyInArrow(climb_on, ROWS)
        up = materialise(up, "trie-shard-roots")
        found.append(up.where("kind = 'node'"))
        if last:
            break
        opened, shards = up.where("kind = 'open'"), groups
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    once_open = small(materialise(nodes.where("key IS NOT NULL").select("key", "conv_id").join(ends, "key", "left"), "trie-open"))
    out = nodes.join(once_open.select(F.col("key").alias("above"), F.col("conv_id").alias("parent")), "above", "left")
    out = out.join(once_open.select("key", "digest"), "key", "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "parent").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), each rebuilt with a common head.

    Turns are ordered by ``turn``, null first; equal ones by the digest of role and text. Null
    roles and texts are empty; rows without an id take no part; repeated rows are turns of their
    own; other columns are not read. Turns are compared by 128 bits of SHA-256.
    """
    return prefix_trie(rebuilt(conversations))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM turns),
crc AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
           string_split(conv_id::VARCHAR, ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
           lambda x, y: CASE WHEN y >= 256 THEN xor(x, y - 256)
                             WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM turns)),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, crc % 9 AS h FROM crc),
built AS (
  SELECT c.conv_id, p.pos, p.digest, p.size FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, p.pos, p.digest, p.size FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h),
paths AS (
  SELECT c.conv_id, coalesce(list(b.digest ORDER BY b.pos) FILTER (b.pos IS NOT NULL), []) AS p,
         coalesce(list(b.size ORDER BY b.pos) FILTER (b.pos IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id),
starts AS (
  SELECT conv_id, len(p) AS length, s, p, unnest(range(0, len(p) + 1)) AS depth FROM paths),
nodes AS (
  SELECT depth, array_to_string(p[1:depth], '') AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN depth > 0 THEN s[depth] ELSE 0 END) AS size,
         coalesce(string_agg(CASE WHEN length = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM starts GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, key[1:64 * (depth - 1)] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, key)),
upward AS (SELECT n_convs, size, n_children, key, unnest(range(0, depth + 1)) AS depth FROM known),
below AS (
  SELECT depth, key[1:64 * depth] AS key, sum((n_convs - 1) * size)::BIGINT AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves FROM upward GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, sha256(n.ends) AS ends_sha256
FROM known n JOIN below b USING (depth, key)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:64 * (n.depth - 1)]
"""
