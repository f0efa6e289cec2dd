"""Exact join of documents by the Jaccard similarity of their word n-grams, with prefix trees."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from llm.common import give_back, kept, per_row, texts, words_of
from mandigrid.session import materialise

# Entries of the list of frequent n-grams, which go last in the global order. Any such list
# gives the same links; it only keeps shared passages out of the prefixes.
FREQUENT = 200_000
# Rounds in which near copies meet by two min-hashes of their whole sets, before prefixes are
# looked at.
ROUNDS = 3
# Odd factors, one for each min-hash: multiplied by one, the hashes stand in another order.
ORDERS = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") | 1 for k in range(2 * ROUNDS)], np.uint64)
# Sets that one prefix tree holds; larger blocks are several trees.
TREE_SETS = 512
# Ids or n-grams that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
# Word hashes that a worker remembers.
REMEMBERED = 150_000


class Hashes(dict):
    """64-bit hash of each word, found on first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = kept("word hashes", Hashes)
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``n`` words; of all words, if fewer; none of none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(n, len(h))
    count = len(h) - width + 1
    value = np.full(count, width, np.uint64)
    for k in range(width):
        value = (value ^ h[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return np.unique(value)


def set_key(grams: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def ordered(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """In the global order: frequent n-grams last, by hash otherwise."""
    if not len(frequent) or not len(grams):
        return grams
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    late = frequent[at] == grams
    return np.concatenate([grams[~late], grams[late]])


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The n-gram that comes first in each of the ORDERS, frequent or not: sets share each with the
    probability of their similarity, however many sets share them."""
    return np.array([(grams * factor).min() for factor in ORDERS], np.uint64)


def prefix_length(n, percent: int):
    """Sets of which ``percent`` of the union are shared have one of this many first n-grams in
    common: a partner shares at least ``percent`` of these n."""
    return n - (percent * n + 99) // 100 + 1


def needed(n: int, m: int, percent: int) -> int:
    """The least intersection of linked sets of sizes ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


class Tree:
    """Sets in the global order, each node a run of n-grams that the sets below share.

    A join walks down with the overlap so far. It leaves a subtree when even all that remains,
    of the set sought and of the longest set below, can't bring the overlap to what the
    shortest set below needs, or when all sets below are in the seeker's class already.
    """

    def __init__(self, sets: list[list[int]]):
        self.keys = sets
        self.root = self._node(sorted(range(len(sets)), key=sets.__getitem__), 0)

    def _node(self, ids: list[int], depth: int):
        """(own n-grams, sets that end here, children, sizes below, ids below) of sorted sets
        that agree up to ``depth``."""
        first, last, stop = self.keys[ids[0]], self.keys[ids[-1]], depth
        top = min(len(first), len(last))
        while stop < top and first[stop] == last[stop]:  # sorted: all between agree as well
            stop += 1
        ends = [i for i in ids if len(self.keys[i]) == stop]
        children, rest, at = [], ids[len(ends):], 0
        while at < len(rest):
            token, begin = self.keys[rest[at]][stop], at
            while at < len(rest) and self.keys[rest[at]][stop] == token:
                at += 1
            children.append(self._node(rest[begin:at], stop))
        sizes = [len(self.keys[i]) for i in ids]
        return first[depth:stop], ends, children, min(sizes), max(sizes), ids, stop

    def linked(self, keys: list, percent: int, skip) -> list[int]:
        """Sets that ``keys`` links to; ``skip(ids)``: no need to look at any of these sets."""
        n, have, found = len(keys), set(keys), []
        stack = [(self.root, 0)]
        while stack:
            (run, ends, children, least, most, ids, depth), overlap = stack.pop()
            if skip(ids):
                continue
            overlap += sum(map(have.__contains__, run))
            if overlap + min(n - overlap, most - depth) < needed(n, least, percent):
                continue
            found += [i for i in ends if overlap >= needed(n, depth, percent)]
            stack += [(child, overlap) for child in children]
        return found


class Classes:
    """Union-find over small whole numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def of(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.of(i), self.of(j)
        self.parent[max(a, b)] = min(a, b)


def frequent_grams(docs: DataFrame, n: int) -> np.ndarray:
    """The FREQUENT most frequent of the n-grams that three documents of a batch have; copies
    in a batch count once."""
    def run(batches):
        for batch in batches:
            sets = {set_key(s): s for s in (shingles(words_of(t, True), n) for t in texts(batch.column(0)))}
            joined = np.concatenate([*sets.values(), np.empty(0, np.uint64)])
            del sets
            joined.sort()
            # an n-gram that three documents have stands at three places in a row
            third = np.unique(joined[2:][joined[2:] == joined[:-2]])
            counts = np.searchsorted(joined, third, "right") - np.searchsorted(joined, third)
            yield pa.RecordBatch.from_arrays([pa.array(third.view(np.int64)), pa.array(counts)], names=["gram", "n"])
        give_back()

    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toArrow()  # FREQUENT numbers at most
    return np.sort(rows["gram"].to_numpy().view(np.uint64))


def described(docs: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), prefix and min-hashes of each document."""
    def make():
        late = frequent.value

        def function(batch):
            sizes, keys, prefixes, sketches = [], [], [], []
            for text in texts(batch.column(0)):
                grams = shingles(words_of(text, True), n)
                sizes.append(len(grams))
                keys.append(set_key(grams))
                prefixes.append(ordered(grams, late)[:prefix_length(len(grams), percent)].view(np.int64) if len(grams) else [])
                sketches.append(min_hashes(grams).view(np.int64) if len(grams) else [])
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64()))]

        return function

    return per_row(docs, ["text"], "n_shingles long, set_key binary, prefix array<long>, sketch array<long>", make, ["doc_id"])


def sets_of(docs: DataFrame, ids: DataFrame, n: int, frequent) -> DataFrame:
    """node and its n-grams in the global order, for the documents in ``ids`` (node)."""
    chosen = docs.select("doc_id", "text").join(small(ids), F.col("doc_id") == F.col("node"), "left_semi")

    def make():
        late = frequent.value
        return lambda batch: [pa.array([ordered(shingles(words_of(t, True), n), late).view(np.int64)
                                        for t in texts(batch.column(0))], pa.list_(pa.int64()))]

    return per_row(chosen, ["text"], "grams array<long>", make, ["doc_id"]).withColumnRenamed("doc_id", "node")


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Classes (a) that links within blocks of sets lead to a smaller class (b) of the block, the
    smallest that is reached there: ``members`` has block, node, class, grams and host.

    Each set is looked for among the hosts that stand behind it; guests stand before all hosts.
    Links inside a class that is joined already are not looked for: they change no class.
    """
    arrow = to_arrow_schema(EDGES)

    def join(table):
        table = table.sort_by("host")  # guests first
        guests, hosts = table["host"].to_pylist().count(False), table["host"].to_pylist().count(True)
        if not hosts:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, schema=arrow)
        given, sets = table["class"].to_pylist(), table["grams"].to_pylist()
        first: dict[int, int] = {}
        classes = Classes(len(sets))
        for i, c in enumerate(given):
            classes.join(first.setdefault(c, i), i)
        of, tree = classes.of, Tree(sets[guests:])
        for i, grams in enumerate(sets):
            done = lambda ids: all(guests + j <= i or of(guests + j) == of(i) for j in ids)  # noqa: E731, B023
            for j in tree.linked(grams, percent, done):
                classes.join(i, guests + j)
        least: dict[int, int] = {}
        for c, i in first.items():
            least[of(i)] = min(c, least.get(of(i), c))
        edges = [(c, least[of(i)]) for c, i in first.items() if c != least[of(i)]]
        a, b = zip(*edges) if edges else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    return members.select("block", "class", "grams", "host").groupBy("block").applyInArrow(join, EDGES)


def ends(edges: DataFrame, **marks) -> DataFrame:
    """Each edge from both its ends, in one pass: a, b and the ``marks``, (its value as it stands, and turned)."""
    sides = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), *[F.lit(v[k]).alias(c) for c, v in marks.items()])
             for k, (x, y) in enumerate((("a", "b"), ("b", "a")))]
    return edges.select(F.explode(F.array(*sides)).alias("end")).select("end.*")


def settled(edges: DataFrame) -> bool:
    """Whether ``edges`` (a > b) are stars: no node has two smaller ones, or a smaller and a larger one."""
    of = ends(edges, down=(1, 0)).groupBy("a").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return of.where("down > 0 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and class (smallest node reachable) of every node of ``edges`` (a, b).

    Alternating large and small stars, until only stars are left; the number of rounds grows with
    the logarithm of the longest chain. Each half of a round is written out and reads what it needs
    twice from there: a plan of more steps holds the earlier ones over and over, and the driver all of that.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = materialise(stars, "jaccard-stars")
    while not settled(stars):
        both = ends(stars)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large, "jaccard-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        stars = large.join(least, "a").select(F.explode(near).alias("end")).select("end.*").where("a <> b").distinct()
        stars = materialise(stars, "jaccard-stars")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("class")).union(roots)


def of_class(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``nodes`` with their class; a node without one is its own."""
    return nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def near_classes(grams: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that may have linked nodes: ``grams`` has the prefix n-grams of each class
    (gram, class) and the sizes (least, most) of the sets that they are of.

    The prefixes of linked sets share as many as the one that ends first has, less what its set
    may lack. Of sets of several sizes the smallest and the largest need the fewest.
    """
    left, right = (grams.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "least", "most")]) for s in "lr")
    sizes = (100 * F.col("most_l") >= percent * F.col("least_r")) & (100 * F.col("most_r") >= percent * F.col("least_l"))
    shared = (left.join(right, "gram").where((F.col("class_l") < F.col("class_r")) & sizes).groupBy("class_l", "class_r")
              .agg(F.count("*").alias("n"), *[f(f"{c}_{s}").alias(f"{c}_{s}") for s in "lr" for c, f in (("least", F.min), ("most", F.max))]))
    small, large = F.least("least_l", "least_r"), F.greatest("most_l", "most_r")
    due = F.floor((percent * (small + large) + 99 + percent) / (100 + percent)) + 1 - F.floor((percent * large + 99) / 100)
    one_size = (F.col("least_l") == F.col("most_l")) & (F.col("least_r") == F.col("most_r"))
    # rounding may make one n-gram of a difference in between
    return shared.where(F.col("n") >= due - F.when(one_size, 0).otherwise(1)).select("class_l", "class_r")


def meetings(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """block, node, class and host for all ``pairs`` of classes, whose nodes are ``members``.

    The larger class is host to the smaller ones. Its nodes and those of its guests are dealt into parts
    of about TREE_SETS, and each part of the one meets each part of the other in a block.
    """
    sides = pairs.select(F.col("class_l").alias("class")).union(pairs.select(F.col("class_r").alias("class"))).distinct()
    members = materialise(members.join(sides, "class", "left_semi"), "jaccard-members")
    size = members.groupBy("class").agg(F.count("*").alias("size"))
    sized = pairs
    for s in "lr":
        sized = sized.join(size.select(F.col("class").alias(f"class_{s}"), F.col("size").alias(f"size_{s}")), f"class_{s}")
    large = F.col("size_l") >= F.col("size_r")
    invited = materialise(sized.select(
        F.when(large, F.col("class_l")).otherwise(F.col("class_r")).alias("of"), F.when(large, F.col("class_r")).otherwise(F.col("class_l")).alias("guest"),
        F.greatest("size_l", "size_r").alias("hosts"), F.least("size_l", "size_r").alias("guests")), "jaccard-invited")
    parts = invited.groupBy("of").agg(F.ceil(F.max("hosts") / TREE_SETS).alias("host_parts"), F.ceil(F.sum("guests") / TREE_SETS).alias("guest_parts"))

    def dealt(rows, own, other, host):
        return rows.select("of", "node", "class", F.pmod(F.xxhash64("node", F.lit(own)), F.col(own)).alias(own),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)).select(
            F.xxhash64("of", "host_parts", "guest_parts").alias("block"), "node", "class", F.lit(host).alias("host"))

    hosts = members.join(parts.withColumn("class", F.col("of")), "class")
    guests = members.join(invited.join(parts, "of").withColumn("class", F.col("guest")), "class")
    return dealt(hosts, "host_parts", "guest_parts", True).union(dealt(guests, "guest_parts", "host_parts", False))


def join_classes(docs: DataFrame, n=5, percent=80) -> DataFrame:
    """doc_id, n_shingles, component_id of each document.

    Documents link when the intersection of their sets of word n-grams is at least
    ``percent`` of the union; a component is what links reach, named by its smallest id. The
    join is exact: linked sets share an n-gram among their first (frequent n-grams last), so

    1. copies are one node, and each node gives out its prefix n-grams;
    2. in ROUNDS by two min-hashes, a node that has them in common with nodes of other classes
       meets these in a block, in which a prefix tree of the whole sets finds the links; classes
       are joined after each, so that few n-grams are left that stand in several;
    3. those give pairs of classes. The prefixes of a pair must share what the sizes ask for.
       The nodes of the larger class are put into prefix trees in bounded blocks, in which those
       of the smaller ones are looked for.

    No group is expanded into pairs of the same class, so large groups of copies or near
    copies cost one look a member and round. Ids are whole numbers; rows with the same id
    are one node with all their texts, and a null id gets a null component. Null and empty texts have no
    n-grams and are alone. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, n))
    rows = materialise(described(docs, n, percent, frequent), "jaccard-prefixes")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = full.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1")
    copy_of = materialise(full.select("doc_id", "set_key").join(copies, "set_key").where("doc_id <> node")
                          .select("doc_id", "set_key", "node").distinct(), "jaccard-copies")
    # of an id with several texts only those leave that are copies of a smaller id's
    nodes = full.join(small(copy_of.select("doc_id", "set_key")), ["doc_id", "set_key"], "left_anti").select(
        F.col("doc_id").alias("node"), "n_shingles", "prefix", "sketch")
    classes = None

    def named():
        return nodes.withColumn("class", F.col("node")) if classes is None else of_class(nodes, classes)

    def joined(links):
        """``links`` of classes, and each node's to its class."""
        return links if classes is None else links.union(classes.select("node", "class"))

    def meet(number):
        """The classes that all links so far lead to, with those found in blocks by two min-hashes."""
        at = 2 * number
        keyed = named().select("node", "class", F.xxhash64(F.get("sketch", F.lit(at)), F.get("sketch", F.lit(at + 1))).alias("key"))
        groups = keyed.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n"))
        tree = F.pmod(F.xxhash64("node", F.lit(number)), F.ceil(F.col("n") / TREE_SETS))
        met = keyed.join(groups.where("x <> y"), "key").select(F.xxhash64("key", tree).alias("block"), "node", "class",
                                                        F.lit(True).alias("host"))
        met = materialise(met, "jaccard-blocks")
        sets = sets_of(docs, met.select("node"), n, frequent)
        links = block_links(met.join(sets, "node"), percent)
        return small(materialise(components(joined(links)), "jaccard-classes"))

    for number in range(ROUNDS):
        classes = meet(number)
    every = Window.partitionBy("gram")
    grams = named().select("class", F.col("n_shingles").cast("int").alias("size"), F.explode("prefix").alias("gram"))
    grams = grams.withColumn("x", F.min("class").over(every)).withColumn("y", F.max("class").over(every)).where("x <> y")
    grams = materialise(grams.groupBy("gram", "class").agg(F.min("size").alias("least"), F.max("size").alias("most")), "jaccard-grams")
    pairs = materialise(near_classes(grams, percent), "jaccard-pairs")
    meet = materialise(meetings(pairs, named().select("node", "class").distinct()), "jaccard-blocks")
    sets = sets_of(docs, materialise(meet.select("node").distinct(), "jaccard-nodes"), n, frequent)
    links = joined(block_links(meet.join(sets, "node"), percent))
    found = components(links.union(copy_of.select("doc_id", "node"))).select(F.col("node").alias("doc_id"), "class")
    out = rows.select("doc_id", "n_shingles").join(materialise(found, "jaccard-classes"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, s.y FROM reach r JOIN shared s ON r.y = s.x)
SELECT d.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM documents d JOIN sets s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
