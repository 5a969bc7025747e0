"""Vectors that take part in a search, with equal ones looked at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.runtime import Scratch, ship_code, with_rank

#: Distinct query vectors that one pass over the rows serves. Bounds what the
#: driver and each task hold of the queries.
BLOCK = 2_048


def finite(v: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False))


def common_width(vectors: DataFrame) -> int:
    """The most frequent length of ``v`` (the smaller of equally frequent ones), or 0."""
    top = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def distinct_vectors(scratch: Scratch, vectors: DataFrame, k: int) -> DataFrame:
    """(rid, v, ids): each distinct ``v`` of (vec_id, v) once, with its k + 1 smallest ids.

    More can't be in anyone's k nearest: ties go to smaller ids and one id may be
    the query's own. The ids are cut inside each partition before the shuffle.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    first = vectors.select("vec_id", "v").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    reps = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return scratch.write(reps.select(F.monotonically_increasing_id().alias("rid"), "v", "ids"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), width)


def best_of(found: DataFrame, reps: DataFrame, queries: DataFrame, k: int, ascending: bool) -> DataFrame:
    """Answers per query row from scored pairs of distinct vectors.

    ``found`` has (qid, rid, score), ``queries`` (query_id, qid). The best k + 1
    ids of a query vector serve all queries that share it; each leaves out itself.
    """
    key = F.col("score").asc() if ascending else F.col("score").desc()  # never negated: the smallest long has no opposite
    near = Window.partitionBy("qid").orderBy(key, F.col("ids")[0])
    kept = found.join(reps.select("rid", "ids"), "rid").withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1)
    one = kept.select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(key, "vec_id")
    top = one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("items"))
    mine = F.slice(F.filter("items", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    rows = queries.join(lists.withColumnRenamed("qid", "_q"), F.col("qid") == F.col("_q")).select("query_id", F.posexplode(mine).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


class Best:
    """The k + 1 best (score, first id, rid) of each query that a task has seen so far: the largest longs or the smallest doubles."""

    def __init__(self, queries: int, keep: int, largest: bool) -> None:
        self.keep, self.largest = keep, largest
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, q: int, scores: np.ndarray, first: np.ndarray, rids: np.ndarray) -> None:
        if self.largest:  # longs: the smallest has a complement but no opposite
            order = np.lexsort((first, ~scores))[: self.keep]
        else:
            order = np.lexsort((first, scores))[: self.keep]
        new = [(-s if self.largest else s, f, r, s) for s, f, r in zip(scores[order].tolist(), first[order].tolist(), rids[order].tolist(), strict=True)]
        self.rows[q] = sorted(self.rows[q] + new)[: self.keep]

    def last(self, q: int) -> float | None:
        """The worst score that still counts, or None while there is room."""
        return self.rows[q][-1][3] if len(self.rows[q]) == self.keep else None

    def batches(self, qids: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        out = [(int(qids[q]), r, s) for q, rows in enumerate(self.rows) for _, _, r, s in rows]
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        kinds = [pa.int64(), pa.int64(), kind]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["qid", "rid", "score"])


def by_blocks(scratch: Scratch, rows: DataFrame, queries: DataFrame, width: int, task: Callable, kind: str, block: int = BLOCK) -> DataFrame:
    """Scored pairs (qid, rid, score) of all queries (rid, v) against all ``rows``.

    One pass over the rows for each block of queries; ``task(qids, matrix)`` gives
    the function that runs over a partition's batches and yields its best pairs.
    """
    ship_code(scratch.spark)
    numbered = scratch.write(with_rank(scratch, queries.withColumn("_all", F.lit(0)), ["_all"], [F.col("rid")], "_k"))
    total, out = numbered.count(), None
    for low in range(0, max(total, 1), block):
        mine = numbered.where((F.col("_k") >= low) & (F.col("_k") < low + block)).orderBy("_k").select("rid", "v").toPandas()
        q = np.array([np.asarray(v, dtype=np.float64) for v in mine["v"]]).reshape(len(mine), max(width, 1))
        found = scratch.write(rows.mapInArrow(task(mine["rid"].to_numpy(dtype=np.int64), q), f"qid long, rid long, score {kind}"))
        out = found if out is None else out.unionByName(found)
    return out
