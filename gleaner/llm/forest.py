"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are fitted on a bounded sample and every vector is then put into its leaf
of each tree. A query walks all trees with one shared priority queue, closest
split first, until the leaves it has reached hold enough vectors; these
candidates are ranked by their exact distance. How many are enough is learned
from the sample: its own nearest pairs tell how far a walk has to go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.vectors import Best, best_of, by_blocks, common_width, distinct_vectors, finite, matrix
from gleaner.runtime import Scratch, ship_code

#: Parameters of the index. The sample bounds what the driver holds.
SAMPLE, TREES, LEAF = 20_000, 16, 64
#: A query stops when its leaves hold enough vectors, counted once for each tree:
#: the share of all that reaches ``AIM`` of the true neighbours of ``TRIED`` vectors
#: of the sample, and no less than ``SEARCH_LEAST``. Clustered vectors need a small
#: share, vectors without structure about as many as there are.
AIM, TRIED, SEARCH_LEAST = 0.97, 128, 500


@dataclass
class Tree:
    """Inner nodes by number: direction, split value and the two children.

    A child below zero is the leaf -1 - child.
    """

    directions: np.ndarray
    splits: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        if not len(self.splits):
            return node
        open_ = np.arange(len(x))
        while len(open_):
            at = node[open_]
            side = (np.einsum("ij,ij->i", x[open_], self.directions[at]) > self.splits[at]).astype(np.int64)
            node[open_] = self.children[at, side]
            open_ = open_[node[open_] >= 0]
        return -1 - node


def grow_tree(x: np.ndarray, leaf: int, seed: int) -> Tree:
    """Split the sample at the median of a random direction between two of its points."""
    rng = np.random.default_rng(seed)
    directions, splits, children, leaves = [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        here = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                d = a - b
                p = x[rows] @ d
                split = float(np.median(p))
                if (p > split).any() and (p <= split).any():
                    here = len(splits)
                    directions.append(d / (np.linalg.norm(d) or 1.0))
                    splits.append(split / (np.linalg.norm(d) or 1.0))
                    children.append([0, 0])
                    above = p > split
                    todo += [(rows[~above], here, 0), (rows[above], here, 1)]
                    break
        if here is None:
            here = -1 - leaves
            leaves += 1
        if parent >= 0:
            children[parent][side] = here
    width = x.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(splits), np.array(children, dtype=np.int64).reshape(-1, 2), max(leaves, 1))


def probe(forest: list[Tree], sizes: list[np.ndarray], q: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Leaves of all trees in the order of one queue, until they hold ``enough`` vectors."""
    queue: list[tuple[float, int, int]] = [(-np.inf, t, 0 if len(tree.splits) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    sides = [tree.directions @ q - tree.splits for tree in forest]
    found, held = [], 0
    while queue and held < enough:
        cost, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -1 - node))
            held += int(sizes[t][-1 - node])
            continue
        margin = sides[t][node]
        near = 1 if margin > 0 else 0
        heapq.heappush(queue, (cost, t, int(forest[t].children[node, near])))
        heapq.heappush(queue, (max(cost, abs(margin)), t, int(forest[t].children[node, 1 - near])))
    return found


def leaf_costs(tree: Tree, q: np.ndarray) -> np.ndarray:
    """(query, leaf): the priority at which the queue gets to each leaf, for all queries ``q`` at once."""
    out = np.full((tree.leaves, len(q)), -np.inf)
    margins = tree.directions @ q.T - tree.splits[:, None]
    costs = np.full(margins.shape, -np.inf)
    for node, margin in enumerate(margins):  # a parent's number is below its children's
        for side, child in enumerate(tree.children[node]):
            turned_away = (margin > 0) != (side == 1)
            cost = np.where(turned_away, np.maximum(costs[node], np.abs(margin)), costs[node])
            (out if child < 0 else costs)[-1 - child if child < 0 else child] = cost
    return out.T


def needed_share(forest: list[Tree], x: np.ndarray, k: int, aim: float = AIM, tried: int = TRIED) -> float:
    """How far a walk must go, as a share of all vectors, to meet ``aim`` of the ``k`` nearest.

    For some vectors of the sample ``x``, spread evenly over it, the true neighbours
    in the sample are known, and so is what the walk holds when it gets to the first
    leaf with each of them. Nearest neighbours among all vectors are closer than
    those in a sample of them, so the share errs on the long side.
    """
    n = len(x)
    if n < 2:
        return float(len(forest))
    places = np.stack([tree.leaf_of(x) for tree in forest], axis=1)
    sizes = np.concatenate([np.bincount(places[:, t], minlength=tree.leaves) for t, tree in enumerate(forest)])
    start = np.cumsum([0] + [tree.leaves for tree in forest[:-1]])
    asked = np.unique(np.linspace(0, n - 1, min(tried, n)).astype(np.int64))
    distances = (x**2).sum(axis=1) - 2 * (x[asked] @ x.T)  # but for the query's own norm
    distances[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(distances, axis=1, kind="stable")[:, : min(k, n - 1)]
    costs = np.concatenate([leaf_costs(tree, x[asked]) for tree in forest], axis=1)
    needed = []
    for cost, rows in zip(costs, near, strict=True):
        order = np.argsort(cost, kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(sizes[order]) - sizes[order]
        needed.extend((held[start + places[rows]].min(axis=1) + 1) / n)  # the walk goes on while it holds less than this
    return float(np.quantile(needed, aim, method="higher"))


def search_forest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF,
    share: float | None = None, least: int = SEARCH_LEAST, seed: int = 11,
) -> DataFrame:
    """Each query's k nearest among the candidates it reaches: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` are (vec_id, v); a query is never its own answer.
    The score is the Euclidean distance in double precision, ties go to the
    smaller vec_id. A walk ends at ``share`` of all vectors, by default the one that
    the sample needs, and not before ``least``. Null, empty, zero or non-finite vectors, null ids and vectors
    of another than the most frequent length take no part. Equal vectors are
    searched once, however many there are, and a row that repeats an id and its
    vector counts once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "forest")
    usable = F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    vectors = vectors.where(usable)
    width = common_width(vectors)
    vectors, queries = vectors.where(F.size("v") == width), queries.where(usable & (F.size("v") == width))
    reps = distinct_vectors(scratch, vectors, k)
    total = reps.count()
    unit = F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(1 << 53))
    taken = reps.where(unit < min(1.0, sample / max(total, 1))).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, dtype=np.float64) for v in taken]).reshape(len(taken), max(width, 1))
    x = x[np.lexsort(x.T[::-1])]
    per_leaf = max(1, int(np.ceil(leaf * len(x) / max(total, 1))))
    forest = [grow_tree(x, max(per_leaf, 4), seed + t) for t in range(trees)]

    def into_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"), width)
            leaves = np.stack([tree.leaf_of(m) for tree in forest], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, trees, dtype=np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("first"), batch.column("v"), lists], names=["rid", "first", "v", "leaves"])

    plain = reps.select("rid", F.col("ids")[0].alias("first"), F.col("v").cast("array<double>").alias("v"))
    placed = scratch.write(plain.mapInArrow(into_leaves, "rid long, first long, v array<double>, leaves array<int>"))
    sizes = [np.zeros(tree.leaves, dtype=np.int64) for tree in forest]
    for r in placed.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").count().collect():  # a row per leaf of the forest
        sizes[r["t"]][r["leaf"]] = r["count"]
    enough = max(least, int(np.ceil((needed_share(forest, x, k) if share is None else share) * total)))

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("_v")).distinct()
    asked = scratch.write(asked.join(reps.select(F.col("rid").alias("qid"), "v"), F.col("_v") == F.col("v")).select("query_id", "qid"))
    distinct = reps.join(asked.select(F.col("qid").alias("_q")).distinct(), F.col("rid") == F.col("_q"), "left_semi").select("rid", "v")

    def task(qids: np.ndarray, q: np.ndarray):
        """Ranks the rows in each query's leaves by their exact distances."""
        reached = [np.zeros((tree.leaves, len(q)), dtype=bool) for tree in forest]
        for k, x in enumerate(q):
            for t, where in probe(forest, sizes, x, enough):
                reached[t][where, k] = True
        reached = [np.packbits(r, axis=1) for r in reached]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(q), k_and_own, largest=False)
            for batch in batches:
                if not len(batch) or not len(q):
                    continue
                m, rids = matrix(batch.column("v"), width), batch.column("rid").to_numpy()
                first = batch.column("first").to_numpy()
                hit = np.zeros((len(m), reached[0].shape[1]), dtype=np.uint8)
                for t, leaf_ids in enumerate(matrix(batch.column("leaves"), trees).astype(np.int64).T):
                    hit |= reached[t][leaf_ids]
                hit = np.unpackbits(hit, axis=1, count=len(q)).astype(bool).T
                for k in range(len(q)):
                    rows = np.flatnonzero(hit[k])
                    if len(rows):
                        best.add(k, np.sqrt(((m[rows] - q[k]) ** 2).sum(axis=1)), first[rows], rids[rows])
            yield from best.batches(qids, pa.float64())

        return run

    k_and_own = k + 1
    scored = by_blocks(scratch, placed, distinct, width, task, "double")
    return best_of(scored, reps, asked, k, ascending=True)


def op4_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return search_forest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
