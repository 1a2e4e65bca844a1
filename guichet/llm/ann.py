"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of vectors (FIT rows of least hash) and is all that is sent to the tasks. Every
vector goes to one leaf. A query walks the tree with a priority queue of the branches not yet taken, by the distance to
their centres, and so meets leaves in order of promise. How many leaves it visits is calibrated: the visits are widened
until the mean recall of CALIBRATION sampled queries, measured against all rows, reaches the target; the searches of all
queries use that number. With as many visits as leaves the search is exact.

Equal vectors are one row for the search; each keeps the k + 1 smallest ids, enough for any query. Leaves are joined to
queries in blocks of bounded size, so a leaf that a third of all rows fall into is shared by many tasks.

Vectors that are null, zero, of another length than most, or hold a null, NaN or infinity take no part, neither as
queries nor as candidates; so do rows with a null id. With fewer candidates than k all are returned; repeated rows with
one id are one candidate. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.llm.common import column, staged

#: Vectors the tree is fitted on, children of a node, fitted vectors of a leaf.
FIT, BRANCH, LEAF = 20_000, 8, 48
CALIBRATION, TARGET = 64, 0.97
#: Distinct vectors of a leaf that one task compares with a block of queries.
BLOCK, QUERIES = 4096, 512


def matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


class Tree:
    """Nodes as lists of centres and children; a child below 0 is leaf -child - 1."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self._grow(vectors, np.random.default_rng(seed))

    def _grow(self, vectors: np.ndarray, rng: np.random.Generator) -> int:
        if len(vectors) <= LEAF or (vectors == vectors[0]).all():
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(np.zeros(0))
        self.children.append([])
        centres, own = _means(vectors, min(BRANCH, len(vectors)), rng)
        if len(centres) == 1:
            self.leaves += 1
            self.centres[node], self.children[node] = centres, [-self.leaves]
            return node
        self.centres[node] = centres
        self.children[node] = [self._grow(vectors[own == j], rng) for j in range(len(centres))]
        return node

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(vectors), np.int64)
        if not self.centres:
            return out
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            near = _squares(vectors[rows], self.centres[node]).argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                inside = rows[near == j]
                if len(inside) and child < 0:
                    out[inside] = -child - 1
                elif len(inside):
                    todo.append((child, inside))
        return out

    def order(self, vector: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves, best bin first."""
        if not self.centres:
            return [0]
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            while node >= 0:
                near = _squares(vector[None], self.centres[node])[0]
                best = int(near.argmin())
                for j, child in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(queue, (float(near[j]), child))
                node = self.children[node][best]
            out.append(-node - 1)
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b * b).sum(axis=1) - 2 * a @ b.T


def _means(vectors: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), count, replace=False)]
    own = np.zeros(len(vectors), np.int64)
    for _ in range(rounds):
        own = _squares(vectors, centres).argmin(axis=1)
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
        count = len(centres)
    return centres, _squares(vectors, centres).argmin(axis=1)


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.where(fine & F.col("vec_id").isNotNull())
    common = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return vectors.join(F.broadcast(common.select("n")), F.size("embedding") == F.col("n"), "left_semi")  # one row


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): the k + 1 smallest ids of each distinct vector. Copies are thinned within salts first."""
    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = vectors.distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _placed(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf(matrix(column(batch, "embedding")))
                yield pa.record_batch([column(batch, "embedding"), column(batch, "ids"), pa.array(leaf)], names=["embedding", "ids", "leaf"])

    return run


def _routed(tree: Tree, visits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                orders = [tree.order(v, visits) for v in matrix(column(batch, "embedding"))]
                where = pa.array(np.repeat(np.arange(len(orders)), [len(o) for o in orders]))
                flat = [(x, i) for o in orders for i, x in enumerate(o)]
                yield pa.record_batch([column(batch, "query_id").take(where), column(batch, "embedding").take(where), pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64())], names=["query_id", "embedding", "leaf", "turn"])

    return run


def _nearest(k: int) -> Callable:
    """The k nearest of a block of vectors for each query of a group (rows with a query id are queries)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = table["query_id"].is_valid().to_numpy()
        values = matrix(table["embedding"].combine_chunks())
        queries, vectors = values[asked], values[~asked]
        ids, turns, held = table["query_id"].to_pylist(), table["turn"].to_pylist(), [x for x, q in zip(table["ids"].to_pylist(), asked) if not q]
        names, turn = [x for x, q in zip(ids, asked) if q], [x for x, q in zip(turns, asked) if q]
        out: dict[str, list] = {n: [] for n in ("query_id", "vec_id", "score", "turn")}
        rough = (vectors * vectors).sum(axis=1) - 2 * queries @ vectors.T if len(vectors) else np.zeros((len(queries), 0))
        for i, query in enumerate(queries):
            if len(vectors) > 4 * k + 8:  # the exact distance decides among those that the expanded form cannot rule out
                bound = np.partition(rough[i], k)[k]
                near = np.flatnonzero(rough[i] <= bound + 1e-6 * (1 + abs(bound) + (query * query).sum()))
            else:
                near = np.arange(len(vectors))
            d = np.sqrt(((vectors[near] - query) ** 2).sum(axis=1))
            best = sorted((float(x), v) for x, j in zip(d, near) for v in held[j] if v != names[i])[:k]
            for x, v in best:
                out["query_id"].append(names[i]), out["vec_id"].append(v), out["score"].append(x), out["turn"].append(turn[i])
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("turn", pa.int64())]))

    return run


def _compared(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, turn): each query against the blocks of its leaves."""
    blocks = candidates.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    shelved = candidates.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("embedding"), F.col("blocks")))
    share = F.ceil(F.count("*") / QUERIES)
    asked = queries.join(queries.groupBy("leaf").agg(share.alias("shares")), "leaf").join(blocks, "leaf")
    asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    wanted = asked.select("leaf", "shares").distinct()
    shelved = shelved.join(wanted, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    rows = shelved.select("leaf", "block", "share", F.lit(None).cast("long").alias("query_id"), "embedding", "ids", F.lit(0).cast("long").alias("turn"))
    rows = rows.unionByName(asked.select("leaf", "block", "share", "query_id", "embedding", F.lit(None).cast("array<long>").alias("ids"), "turn"))
    return rows.groupBy("leaf", "block", "share").applyInArrow(_nearest(k), "query_id long, vec_id long, score double, turn long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("turn").alias("turn"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "turn")


def _visits(tree: Tree, candidates: DataFrame, sample: DataFrame, k: int) -> int:
    """Least number of leaves, by fourths, that reaches the target recall for the sampled queries."""
    if tree.leaves < 2:
        return 1
    # a stated, bounded set of queries against all rows, in blocks
    asked = sample.select(F.col("vec_id").alias("query_id"), "embedding")
    every = asked.mapInArrow(_routed(tree, tree.leaves), "query_id long, embedding array<float>, leaf long, turn long")
    found = _ranked(_compared(every, candidates, k), k).toArrow()  # CALIBRATION * k rows
    turn = found["turn"].to_numpy()
    visits = 1
    while visits < tree.leaves and (turn < visits).mean() < TARGET:
        visits = min(tree.leaves, max(visits + 1, visits * 5 // 4))
    return visits


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row of `vectors(vec_id, embedding)` with `is_query`."""
    usable = _usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")))
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).select("vec_id", "embedding")
    fitted = sample.toArrow()
    if not fitted.num_rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(np.unique(matrix(fitted["embedding"].combine_chunks()), axis=0))
    candidates = staged(_distinct(usable, k).mapInArrow(_placed(tree), "embedding array<float>, ids array<long>, leaf long"), "leaves")
    calibrating = usable.orderBy(F.xxhash64(F.lit("ask"), "vec_id"), "vec_id").limit(CALIBRATION)
    visits = _visits(tree, candidates, calibrating, k)
    # of several vectors under one id the least one asks
    asked = usable.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    routed = staged(asked.mapInArrow(_routed(tree, visits), "query_id long, embedding array<float>, leaf long, turn long"), "routed")
    return _ranked(_compared(routed, candidates, k), k).drop("turn")
