"""Approximate nearest neighbours by inner product: vantage-point trees per shard."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mandigrid.session import materialise

# Vectors that the shards' centres are taken from, centres, vectors in a tree and in a leaf, at most.
SAMPLE, CENTRES, TREE, LEAF = 4096, 256, 4096, 64
# Queries that meet a tree in one group (on average; by a hash), queries that are compared at
# once, and numbers of the vectors in a batch that is sent to trees.
QUERIES, BLOCK, SENT = 32_768, 512, 1 << 20
# A side of a split is left out if its least possible distance times this exceeds the distance
# of the k-th found. 1: exact search. On unit vectors of 64 dimensions, half of them without
# any neighbourhood, 1.3 finds over 0.97 of the true neighbours.
FACTOR = 1.3


class VantageTree:
    """Vectors split at the median distance from a vantage point, again and again.

    Distances are those of vectors to which a coordinate is added that gives all the length
    of the longest, so that the largest inner product is the smallest distance and the
    triangle inequality holds. A query gets 0 there.
    """

    def __init__(self, vectors: np.ndarray, longest: float):
        self.x = vectors
        self.extra = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self.longest = longest
        self.root = self._split(np.arange(len(vectors)))

    def _split(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        # of a few, the vantage point with the largest spread of distances
        tried = rows[:: max(1, len(rows) // 5)][:5]
        far = [self._between(t, rows) for t in tried]
        best = int(np.argmax([f.var() for f in far]))
        middle = float(np.median(far[best]))
        inside = far[best] <= middle
        if inside.all():
            return rows  # all at one distance
        return tried[best], middle, self._split(rows[inside]), self._split(rows[~inside])

    def _between(self, one: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[one]
        return np.sqrt((d**2).sum(1) + (self.extra[rows] - self.extra[one]) ** 2)

    def search(self, queries: np.ndarray, k: int, tau: np.ndarray, factor: float):
        """Inner products and rows of the ``k`` best for each query, which are no further than
        ``tau`` (squared distance less the query's own part) if pruning is exact.

        Queries go down the tree in blocks: no array grows with their number times the rows'."""
        self.q, self.k, self.factor = queries, k, factor
        self.norm = (queries**2).sum(1)
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)
        self.tau = tau.copy()
        for begin in range(0, len(queries), BLOCK):
            self._visit(self.root, np.arange(begin, min(begin + BLOCK, len(queries))))
        return self.score, self.row

    def _distance(self, active: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm[active] + self.longest**2 - 2 * products, 0))

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for begin in range(0, len(node), 4 * LEAF):
                self._compare(node[begin:begin + 4 * LEAF], active)
            return
        vantage, middle, near, far = node
        d = self._distance(active, self.q[active] @ self.x[vantage])
        inside = d <= middle
        self._visit(near, active[inside])
        late = (middle - d) * self.factor <= self.tau[active]
        self._visit(far, active[~inside | late])
        late = (d - middle) * self.factor <= self.tau[active]
        self._visit(near, active[~inside & late])

    def _compare(self, rows: np.ndarray, active: np.ndarray) -> None:
        score = np.concatenate([self.score[active], self.q[active] @ self.x[rows].T], 1)
        row = np.concatenate([self.row[active], np.broadcast_to(rows, (len(active), len(rows)))], 1)
        # rows stand in the order of their ids, so that of equal scores the smaller id wins
        order = np.lexsort((row, -score), axis=1)[:, : self.k]
        self.score[active] = np.take_along_axis(score, order, 1)
        self.row[active] = np.take_along_axis(row, order, 1)
        worst = self.score[active][:, -1]
        found = np.isfinite(worst)
        self.tau[active[found]] = np.minimum(self.tau[active[found]], self._distance(active[found], worst[found]))


def matrix(column) -> np.ndarray:
    """Vectors of one length, a row each."""
    return np.asarray(pc.list_flatten(column)).reshape(len(column), -1)


def expanded(first: np.ndarray, copies: np.ndarray, most: int):
    """(entry, number) for the ``copies`` numbers from ``first`` on of each entry, in slices of
    ``most`` at most."""
    ends = np.cumsum(copies)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, most):
        place = np.arange(begin, min(begin + most, ends[-1]))
        entry = np.searchsorted(ends, place, "right")
        yield entry, first[entry] + place - (ends - copies)[entry]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part: with an id, not null, empty or
    zero, and all components finite."""
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, queries, k=20, factor=FACTOR, vec_id="vec_id", vector="embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products of each query.

    ``queries`` is a condition on vec_id: these rows are sought among all others. Every vector
    is indexed; a bounded sample (first by a hash) only gives the centres of the shards. Each
    vector belongs to its nearest centre, and shards are dealt over trees of TREE vectors. A
    query goes to the shards that can hold one of its k nearest, by the triangle inequality
    and the k-th nearest in the sample, relaxed by ``factor`` as within the trees.

    Equal vectors are one in the index, with their k + 1 smallest ids: no other can be among
    the nearest. Vectors of different length are never compared. Ties go to the smaller id;
    fewer candidates than k give fewer rows; ids are taken to be unique.
    """
    rows = materialise(usable(vectors, vec_id, vector), "ann-vectors")
    nodes = materialise(rows.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "ann-nodes")
    several = nodes.where("n > 1").select("vec", "node")
    copies = materialise(rows.join(several, "vec").select("node", "vec_id"), "ann-copies")  # of equal vectors only
    shape = nodes.groupBy(F.size("vec").alias("size")).agg(
        F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"), F.count("*").alias("n"))
    out = None
    for size, longest, n in shape.orderBy("size").collect():  # a row for each length of vectors: usually one
        part = nodes.where(F.size("vec") == size)
        found = _search(part, rows.where(F.size("vec") == size).where(queries), longest, n, k, factor)
        out = found if out is None else out.union(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    ids = copies.withColumn("r", first).where(F.col("r") <= k + 1).select("node", "vec_id")
    single = out.join(copies.select("node").distinct(), "node", "left_anti").withColumn("vec_id", F.col("node"))
    every = single.select("query", "vec_id", "score").union(out.join(ids, "node").select("query", "vec_id", "score"))
    # queries with equal vectors share one search
    asked = copies.where(queries).select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    alone = nodes.where("n = 1").select(F.col("node").alias("query"), F.col("node").alias("query_id"))
    pairs = every.join(asked.union(alone), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(nodes, asked, longest, n, k, factor) -> DataFrame:
    """query, node and score: the k + 1 nearest distinct vectors of each distinct query vector."""
    index, sent = _groups(nodes, asked, longest, n, k, factor)
    made = T.StructType.fromDDL("query long, node long, score double")
    arrow = to_arrow_schema(made)

    def within(index_rows, query_rows):
        if not len(index_rows) or not len(query_rows):
            return pa.Table.from_batches([], schema=arrow)
        index_rows = index_rows.sort_by("node")
        ids, x = index_rows["node"].to_numpy(), matrix(index_rows["vec"])
        q, tau = matrix(query_rows["vec"]), query_rows["tau"].to_numpy()
        score, row = VantageTree(x, longest).search(q, k + 1, tau, factor)
        # what lies beyond the k-th nearest of the sample is no neighbour, and isn't sent on
        beyond = np.sqrt(np.maximum((q**2).sum(1)[:, None] + longest**2 - 2 * score, 0)) > tau[:, None] * (1 + 1e-9) + 1e-9
        found = (row >= 0) & ~beyond
        query = np.broadcast_to(query_rows["query"].to_numpy()[:, None], row.shape)
        return pa.Table.from_arrays([pa.array(query[found]), pa.array(ids[row[found]]), pa.array(score[found])], schema=arrow)

    best = index.groupBy("tree", "part").cogroup(sent.groupBy("tree", "part")).applyInArrow(within, made)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return best.withColumn("r", rank).where(F.col("r") <= k + 1).select("query", "node", "score")


def _groups(nodes, asked, longest, n, k, factor) -> tuple[DataFrame, DataFrame]:
    """tree, part, node, vec of the trees' vectors, and tree, part, query, vec, tau of the queries
    sent to them. A tree stands once for each part of its queries, of QUERIES or so each."""
    sample = np.array([r["vec"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").collect()])  # bounded
    centres = sample[: int(np.clip(n // TREE, 1, CENTRES))]
    rows_sent = max(1, SENT // sample.shape[1])

    def lifted(x):
        return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]], 1)

    def distances(x, to):
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (to**2).sum(1) - 2 * x @ to.T, 0))

    def assign(batches):
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1))
                d = distances(lifted(x), lifted(centres))
                shard = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(d[np.arange(len(x)), shard])],
                                                 names=["node", "vec", "shard", "distance"])

    placed = materialise(nodes.select("node", "vec").mapInArrow(assign, "node long, vec array<double>, shard int, distance double"), "ann-shards")
    shards = placed.groupBy("shard").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()  # CENTRES rows at most
    radius, trees = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for s in shards:
        radius[s["shard"]], trees[s["shard"]] = s["radius"], -(-s["n"] // TREE)
    first_tree = np.cumsum(trees) - trees

    def aimed(batches):
        """(block of a batch, its row and shard where they may have neighbours, distance of the k-th in the sample)."""
        known_at, centres_at = lifted(sample), lifted(centres)
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                block = batch.slice(begin, BLOCK)
                x = matrix(block.column(1))
                q = np.concatenate([x, np.zeros((len(x), 1))], 1)
                known = np.sort(distances(q, known_at), 1)
                tau = known[:, k] if known.shape[1] > k else np.full(len(x), np.inf)
                d = distances(q, centres_at)
                bound = np.maximum(d - radius, (d - d.min(1, keepdims=True)) / 2)
                yield block, *np.nonzero((bound * factor <= tau[:, None]) & (trees > 0)), tau

    def tally(batches):
        count = np.zeros(len(centres), np.int64)
        for _, _, shard, _ in aimed(batches):
            count += np.bincount(shard, minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count)], names=["shard", "n"])

    # equal query vectors are sought once
    wanted = materialise(nodes.join(asked.select("vec").distinct(), "vec", "left_semi").select("node", "vec", F.xxhash64("node").alias("hash")), "ann-queries")
    # all trees of a shard get the same queries
    parts = np.ones(len(centres), np.int64)
    for s in wanted.mapInArrow(tally, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # CENTRES rows at most
        parts[s["shard"]] = max(1, -(-s["n"] // QUERIES))

    def route(batches):
        for block, row, shard, tau in aimed(batches):
            part = block.column(2).to_numpy()[row] % parts[shard]
            for entry, tree in expanded(first_tree[shard], trees[shard], rows_sent):
                at = pa.array(row[entry])
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(part[entry]), block.column(0).take(at), block.column(1).take(at), pa.array(tau[row[entry]])],
                                                 names=["tree", "part", "query", "vec", "tau"])

    starts, many, split = (F.array(*map(F.lit, v.tolist())) for v in (first_tree, trees, parts))
    at = F.col("shard") + 1
    tree = (F.element_at(starts, at) + F.pmod(F.xxhash64("node"), F.element_at(many, at))).alias("tree")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(split, at).cast("long") - 1)).alias("part")
    index = placed.select(tree, part, "node", "vec")
    return index, wanted.mapInArrow(route, "tree long, part long, query long, vec array<double>, tau double")
