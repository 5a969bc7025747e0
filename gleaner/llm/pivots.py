"""Exact top-k search by inner product, with pivot-table elimination.

Distances from every vector to many pivots are computed once. By the triangle
inequality the largest difference of two vectors' distances to a pivot bounds
their own distance from below, and so their inner product from above. Rows lie
sorted by their nearest pivot, so that a run of them has narrow ranges of distances
and is ruled out as a whole where even the ranges bound it. Each task takes the
candidates of the other runs in the order of their own bounds and stops where these
fall below the worst score that still counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.vectors import Best, best_of, by_blocks, common_width, distinct_vectors, finite, matrix
from gleaner.runtime import Scratch, ship_code

#: Pivots, and the bounded sample they are picked from.
PIVOTS, SAMPLE = 32, 4_096
#: Candidates that are evaluated together before the bound is looked at again.
STEP = 256
#: Rows of a run that is ruled out as a whole.
RUN = 256
_EXACT = float(1 << 53)


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Points far from each other: each next one is the farthest from those before."""
    if not len(x):
        return x
    chosen = [0]
    away = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def inner_products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the largest or smallest long."""
    if len(m) and np.abs(m).max() * np.abs(q).max() * len(q) < _EXACT:
        return (m @ q).astype(np.int64)
    ints = [int(c) for c in q]
    exact = [sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in m]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], dtype=np.int64)


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(m), 0))


def upper_bounds(own: np.ndarray, square: float, apart: np.ndarray) -> np.ndarray:
    """Bounds of inner products from squared lengths and a lower bound of the distance, above any rounding."""
    bound = (own + square - apart**2) / 2
    bound += 1 + 1e-9 * (own + square)
    return np.maximum(bound, -float(1 << 63))  # where scores stop as well


def rows_in_reach(low: np.ndarray, high: np.ndarray, longest: np.ndarray, to_pivots: np.ndarray, square: float, bar: int, rows: int) -> np.ndarray:
    """Numbers of the rows whose run, by its ranges of distances, may hold a score of ``bar``."""
    apart = np.maximum(low - to_pivots, to_pivots - high).max(axis=1, initial=0.0)
    reach = upper_bounds(longest, square, apart) >= bar
    return np.flatnonzero(np.repeat(reach, RUN)[:rows])


def search_pivots(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """Each query's k highest inner products: query_id, rank, vec_id, score. Exact.

    ``vectors`` and ``queries`` are (vec_id, v) with integers held as doubles; a
    query is never its own answer and ties go to the smaller vec_id. Null, empty
    or non-finite vectors, null ids and vectors of another than the most frequent
    length take no part; zero vectors do. Equal vectors are searched once, and a row
    that repeats an id and its vector counts once. Scores beyond 64 bits stop at the
    largest or smallest long and are ties there. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "pivots")
    usable = F.col("vec_id").isNotNull() & finite(F.col("v"))
    vectors = vectors.where(usable)
    width = common_width(vectors)
    vectors, queries = vectors.where(F.size("v") == width), queries.where(usable & (F.size("v") == width))
    reps = distinct_vectors(scratch, vectors, k)
    total = reps.count()
    unit = F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(1 << 53))
    taken = reps.where(unit < min(1.0, sample / max(total, 1))).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, dtype=np.float64) for v in taken]).reshape(len(taken), max(width, 1))
    points = pick_pivots(x[np.lexsort(x.T[::-1])], pivots)
    n = len(points)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("v"), width), points)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * n), pa.array(d.ravel()))
            near = [pa.array(d.argmin(axis=1) if d.size else np.zeros(len(d), dtype=np.int64)), pa.array(d.min(axis=1, initial=np.inf))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("first"), batch.column("v"), lists, *near], names=["rid", "first", "v", "d", "near", "away"])

    plain = reps.select("rid", F.col("ids")[0].alias("first"), "v")
    measured = plain.mapInArrow(measure, "rid long, first long, v array<double>, d array<double>, near long, away double")
    measured = scratch.write(measured.sortWithinPartitions("near", "away").drop("near", "away"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("_v")).distinct()
    asked = scratch.write(asked.join(reps.select(F.col("rid").alias("qid"), "v"), F.col("_v") == F.col("v")).select("query_id", "qid"))
    distinct = reps.join(asked.select(F.col("qid").alias("_q")).distinct(), F.col("rid") == F.col("_q"), "left_semi").select("rid", "v")
    keep = k + 1

    def task(qids: np.ndarray, q: np.ndarray):
        to_pivots, square = distances(q, points), (q**2).sum(axis=1)
        # What the sample reaches is a floor from the start: its rows are candidates too.
        floors = [np.sort(inner_products(x, y))[::-1][keep - 1] if len(x) >= keep else None for y in q]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(q), keep, largest=True)
            for batch in batches:
                if not len(batch) or not len(q):
                    continue
                m, d = matrix(batch.column("v"), width), matrix(batch.column("d"), n)
                rids, first = batch.column("rid").to_numpy(), batch.column("first").to_numpy()
                own = (m**2).sum(axis=1)
                runs = np.arange(0, len(m), RUN)
                low, high, longest = np.minimum.reduceat(d, runs, axis=0), np.maximum.reduceat(d, runs, axis=0), np.maximum.reduceat(own, runs)
                for k in range(len(q)):
                    bar = [s for s in (best.last(k), floors[k]) if s is not None]
                    rows = rows_in_reach(low, high, longest, to_pivots[k], square[k], max(bar), len(m)) if bar else np.arange(len(m))
                    if not len(rows):
                        continue
                    mine = slice(None) if len(rows) == len(m) else rows  # no copy where all runs stay
                    bound = np.full(len(m), -np.inf)
                    bound[rows] = upper_bounds(own[mine], square[k], np.abs(d[mine] - to_pivots[k]).max(axis=1, initial=0.0))
                    if bar:
                        rows = rows[bound[rows] >= max(bar)]
                    rows = rows[np.argsort(-bound[rows], kind="stable")]
                    for at in range(0, len(rows), STEP):
                        some = rows[at : at + STEP]
                        bar = [s for s in (best.last(k), floors[k]) if s is not None]
                        if bar and bound[some[0]] < max(bar):
                            break
                        best.add(k, inner_products(m[some], q[k]), first[some], rids[some])
            yield from best.batches(qids, pa.int64())

        return run

    scored = by_blocks(scratch, measured, distinct, width, task, "long")
    return best_of(scored, reps, asked, k, ascending=False)


def op10_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding"), lambda x: _floor(x.cast("double") * 1024))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("v"))
    return search_pivots(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def _floor(x):
    """Floor that stays a double, so that large and non-finite numbers pass through."""
    small = F.abs(x) < F.lit(float(1 << 52))
    return F.when(small, F.floor(F.when(small, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
