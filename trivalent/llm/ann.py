"""Nearest neighbours by inner product with a hierarchical k-means tree.

Vectors get one more component, the root of what their squared norm lacks to the largest,
so that the largest inner product is the nearest point. A tree of k-means centres is fitted
on a bounded sample; every vector then descends to its leaf. A query walks the tree best bin
first: a priority queue holds branches by the distance of their centres, and the nearest is
opened next. How many leaves are visited is calibrated: the count is widened until the
sample's queries, compared with brute force over all vectors, reach the recall asked for.

Leaves are dealt to blocks of bounded size, so that a leaf with very many vectors is shared
by tasks; queries are compared with their leaves' blocks by one matrix product a block.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, schema_of, table

#: Vectors that the tree is fitted on at most, and children a node.
SAMPLE, BRANCHES = 50_000, 8
#: Most leaves of a tree, of which half the root of the number of vectors are wanted, and vectors a block.
LEAVES, BLOCK = 32_768, 2048
#: Queries that calibrate, and the recall they must reach.
CALIBRATION, RECALL = 200, 0.97


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that take part: not null or zero, all components finite."""
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.select(F.col(id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & fine & F.exists("x", lambda c: c != 0))


class Tree:
    """Nested k-means centres. children[node] are (centre, node or leaf) rows; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf_size: float, branches: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.below: list[np.ndarray] = []  # >= 0: a node, < 0: leaf ~value
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(sample, leaf_size, branches, rng)

    def _grow(self, x, leaf_size, branches, rng) -> int:
        node = len(self.centres)
        self.centres.append(None)
        self.below.append(None)
        centres, own = _kmeans(x, min(branches, max(2, round(len(x) / leaf_size))), rng)
        below = []
        for k in range(len(centres)):
            part = x[own == k]
            if len(part) <= leaf_size or len(part) == len(x):
                below.append(~self.leaves)
                self.leaves += 1
            else:
                below.append(self._grow(part, leaf_size, branches, rng))
        self.centres[node], self.below[node] = centres, np.array(below)
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf, by descent to the nearest centre at every node."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            nearest = self.below[node][_distances(x[rows], self.centres[node]).argmin(1)]
            for b in np.unique(nearest):
                own = rows[nearest == b]
                if b < 0:
                    out[own] = ~b
                else:
                    todo.append((b, own))
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The leaves that a query visits, best bin first."""
        queue, out = [(0.0, 0, 0)], []
        while queue and len(out) < most:
            _, _, b = heapq.heappop(queue)
            if b < 0:
                out.append(~b)
                continue
            d = ((self.centres[b] - q) ** 2).sum(1)
            for distance, below in zip(d.tolist(), self.below[b].tolist()):
                heapq.heappush(queue, (distance, -len(queue), below))
        return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres of distinct starting points; empty clusters go."""
    start = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    centres = start[rng.permutation(len(start))[:k]]
    for _ in range(rounds):
        own = _distances(x, centres).argmin(1)
        kept, own = np.unique(own, return_inverse=True)
        sums = np.zeros((len(kept), x.shape[1]))
        np.add.at(sums, own, x)
        centres = sums / np.bincount(own)[:, None]
    return centres, _distances(x, centres).argmin(1)


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component: equal vectors have equal products wherever they lie."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return out


def _best(query_ids, q, ids, x, k):
    """The k best rows of x for each query but its own: query's place, id and product. Ties go to the smaller id."""
    rough = q @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    own, which = [], []
    bound = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    slack = 1e-9 * (np.abs(q).max(1) * np.abs(x).max() * q.shape[1] + 1e-300)
    own, which = np.nonzero((rough >= (bound - slack)[:, None]) & (rough > -np.inf))
    score = _products(q[own], x[which])
    order = np.lexsort((ids[which], -score, own))
    own, which, score = own[order], which[order], score[order]
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) if len(own) else np.empty(0, int)
    keep = rank < k
    return own[keep], ids[which[keep]], score[keep]


_FOUND = "query_id long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    values = column.values if isinstance(column, pa.ListArray) else column
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _compare(k: int):
    """A function over rows (queries: list of (id, x), members: list of (id, x)), a block each."""
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                q_ids, q, ids, x = (np.asarray(b.column(c)[at].values.to_numpy(zero_copy_only=False)) if c % 2 == 0 else _nested(b.column(c)[at].values) for c in range(4))
                for s in range(0, len(q_ids), 256):
                    own, found, score = _best(q_ids[s : s + 256], q[s : s + 256], ids, x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[s : s + 256][own]), pa.array(found), pa.array(score)], schema=arrow)

    return run


def _nested(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def brute_force(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the exact k nearest of queries (vec_id, x; few, sent to all tasks) among all vectors."""
    held = [(r.vec_id, r.x) for r in queries.toLocalIterator()]
    ids, x = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x))
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        q_ids, q = shared.value
        for b in batches:
            if b.num_rows and len(q_ids):
                own, found, score = _best(q_ids, q, b.column(0).to_numpy(), _matrix(b.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[own]), pa.array(found), pa.array(score)], schema=arrow)

    return vectors.select("vec_id", "x").mapInArrow(run, schema_of(_FOUND))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, over what tasks have found; a vector that was found twice counts once."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lists(rows: DataFrame, by: list[str], names: tuple[str, str]) -> DataFrame:
    lists = rows.groupBy(*by).agg(F.collect_list(F.struct("vec_id", "x")).alias("list"))
    return lists.select(*by, F.col("list.vec_id").alias(names[0]), F.col("list.x").alias(names[1]))


def _paired(visits: DataFrame, members: DataFrame, size: int = BLOCK) -> DataFrame:
    """Lists (q_ids, q) of queries and (ids, m) of members that share a leaf, each of about `size`.

    Members of a leaf are dealt to blocks by hash, and so are the queries that visit it; the key of the join is a leaf's block, so that a leaf
    with very many members is shared by tasks. Counts are a row a leaf, of which there are LEAVES at most."""

    def deal(rows, name):
        return rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias(name))

    def place(n, salt):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n))

    counts = F.broadcast(checkpointed(deal(members, "blocks").join(deal(visits, "parts"), "leaf")))
    held = members.join(counts, "leaf").withColumn("block", place("blocks", 0))
    asked = visits.join(counts, "leaf").withColumn("part", place("parts", 1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return _lists(asked, ["leaf", "block", "part"], ("q_ids", "q")).join(_lists(held, ["leaf", "block"], ("ids", "m")), ["leaf", "block"])


def nearest(vectors: DataFrame, queries, k: int = 20, sample: int = SAMPLE, leaves: int | None = None, recall: float = RECALL, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """query_id, rank, vec_id, score of the k nearest found for the rows for which the condition `queries` holds, and what was calibrated.

    Vectors that are null, zero, or not finite, and rows without an id, take no part. A query's candidates are the vectors of its own length;
    each length has a tree of its own. Repeated ids are candidates each, but never of their own id; ties go to the smaller id.
    An empty table gives no rows; with k or fewer candidates all are given. Other columns are ignored."""
    rows = checkpointed(usable(vectors, id, vector))
    lengths = sorted(r.d for r in rows.select(F.size("x").alias("d")).distinct().collect())  # mostly one
    found, info = [], {}
    for d in lengths:
        one, info = _nearest(rows.where(F.size("x") == d), queries, k, sample, leaves, recall)
        found.append(one)
    if not found:
        return vectors.sparkSession.createDataFrame([], schema_of("query_id long, rank int, vec_id long, score double")), info
    return functools.reduce(DataFrame.union, found), info


def _nearest(rows: DataFrame, queries, k: int, sample: int, leaves: int | None, recall: float) -> tuple[DataFrame, dict]:
    """nearest() over usable rows of one length."""
    spark = rows.sparkSession
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    n, largest = rows.agg(F.count("*"), F.max(squares)).first()
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "x").toArrow()
    points = _augmented(_matrix(chosen["x"].combine_chunks()), largest)
    leaf_size = len(points) / min(LEAVES, leaves or max(1, n**0.5 / 2), max(1, len(points) / BRANCHES))
    tree = Tree(points, max(leaf_size, 1), BRANCHES)
    shared = spark.sparkContext.broadcast((tree, largest))  # at most LEAVES * 8 / 7 centres

    def place(batches):
        tree, largest = shared.value
        for b in batches:
            if b.num_rows:
                x = _augmented(_matrix(b.column(1)), largest)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.leaf_of(x), pa.int64())], names=["vec_id", "x", "leaf"])

    placed = checkpointed(rows.mapInArrow(place, schema_of("vec_id long, x array<double>, leaf long")))
    asked = placed.where(queries)
    trial = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION).select("vec_id", "x")
    trial = checkpointed(trial.dropDuplicates(["vec_id"]))
    truth = _ranked(brute_force(trial, placed, k), k).join(placed.select("vec_id", "leaf").dropDuplicates(["vec_id"]), "vec_id")
    wanted: dict[int, list[int]] = {}
    for r in truth.select("query_id", "leaf").toLocalIterator():  # CALIBRATION * k rows
        wanted.setdefault(r.query_id, []).append(r.leaf)
    order = {r.vec_id: {leaf: i for i, leaf in enumerate(tree.visits(np.r_[r.x, 0.0], tree.leaves))} for r in trial.toLocalIterator()}
    depths = np.sort([order[q][x] + 1 for q, leaves in wanted.items() for x in leaves])
    most = int(depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))) - 1)]) if len(depths) else 1

    def walk(batches):
        tree, _ = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            leaves = [tree.visits(np.r_[q, 0.0], most) for q in x]
            each = np.repeat(np.arange(len(leaves)), [len(v) for v in leaves])
            if len(each):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), b.column(1).take(pa.array(each)), pa.array(np.concatenate(leaves), pa.int64())], names=["vec_id", "x", "leaf"])

    visits = checkpointed(asked.select("vec_id", "x").mapInArrow(walk, schema_of("vec_id long, x array<double>, leaf long")))
    pairs = _paired(visits, placed)
    found = pairs.select("q_ids", "q", "ids", "m").mapInArrow(_compare(k), schema_of(_FOUND))
    return _ranked(found, k), {"leaves": tree.leaves, "visited": most, "recall": float((depths <= most).mean()) if len(depths) else 1.0}


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)[0]
