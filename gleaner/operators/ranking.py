"""Search: vector, keyword and hybrid ranking of a chunk corpus.

A corpus has source_name, id, text and vector (and any other column); queries have
query_id, query_text and query_vector. One search and a batch share the plan. Up to
``ASKED`` queries at a time come to the driver and travel with the tasks: vectors
are compared by one matrix product per batch of rows, of which only each query's
best leave the task, and texts are looked through for the queries' words in the
same pass that counts them. Pairs of queries and chunks are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as tx
from gleaner.functions import vectors as vx
from gleaner.runtime import Scratch, ship_code

RRF_OFFSET = 60
K1, B = 1.2, 0.75
MAX_K, MAX_CONTEXT = 100, 5
#: Queries that one pass over a corpus serves. Bounds what the driver and a task hold of them.
ASKED = 1_000
#: Distinct query words up to which they are a filter of the postings' scan; beyond it they are joined.
LISTED_TERMS = 256
#: Stands among the terms of a chunk for all of them. Terms are never empty.
LENGTH = ""
#: Ranks compare scores to this many places, so that the order of a sum can't change them.
PLACES = 9
#: Queries up to which, and candidates up to which, a search keeps its candidates on the driver and not as a table.
FEW_QUERIES, FEW_CANDIDATES = 4, 2_000
#: Candidates up to which they are broadcast to the corpus (about 100 bytes each, but for long ids).
BROADCAST_POOL = 50_000


def pool_size(k: int) -> int:
    """Candidates that each ranker gives per source."""
    return max(4 * k, 50)


def blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """The queries, at most about ``ASKED`` of them at a time; one empty block if there are none."""
    first = queries.limit(ASKED + 1).collect()
    if len(first) <= ASKED:
        yield first
        return
    n = -(-2 * queries.count() // ASKED)
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).collect()


def _checked(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def make_queries(spark: SparkSession, rows: list[tuple[int, str, list[float]]]) -> DataFrame:
    """A small local table: reading it takes no job, and its size is known to the planner."""
    kinds = {"query_id": pa.int64(), "query_text": pa.string(), "query_vector": pa.list_(pa.float64())}
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=list(kinds)))


def only_sources(corpus: DataFrame, names: list[str] | None) -> DataFrame:
    """Rows of the named sources; None is all, an empty list nothing. Repeats don't matter."""
    return corpus if names is None else corpus.where(F.col("source_name").isin(list(dict.fromkeys(names))))


def _rank(by: list[str], score: str, cut: int) -> tuple[Column, Column]:
    order = Window.partitionBy(*by).orderBy(F.round(score, PLACES).desc(), "id")
    rank = F.row_number().over(order)
    return rank, rank <= cut


def best_rows(scores: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the ``cut`` largest of each column, with those that tie at the end cut to earlier rows."""
    low = -np.round(scores, PLACES)
    if len(low) > cut:
        within = low <= np.partition(low, cut - 1, axis=0)[cut - 1]
    else:
        within = np.ones(low.shape, dtype=bool)
    column, row = np.nonzero(within.T)
    order = np.lexsort((row, low[row, column], column))
    column, row = column[order], row[order]
    place = np.arange(len(column)) - np.searchsorted(column, column)
    return column[place < cut], row[place < cut]


def _nearest(corpus: DataFrame, asked: list[Row], cut: int, id_type: T.DataType) -> DataFrame:
    """(query_id, source_name, id, cosine): of each batch of rows the best of each query and source."""
    width = max((len(r["query_vector"]) for r in asked if r["query_vector"] is not None), default=0)
    usable = [r for r in asked if r["query_vector"] is not None and len(r["query_vector"]) == width]
    queries = vx.unit_rows(pa.array([list(map(float, r["query_vector"])) for r in usable], pa.list_(pa.float64())), width)
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("source_name", T.StringType()), T.StructField("id", T.StringType()), T.StructField("cosine", T.DoubleType())])
    query_ids = [r["query_id"] for r in usable]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = pa.array(query_ids)
        for batch in batches:
            if not len(batch) or not len(ids_of):
                continue
            named, ids = batch.column("source_name"), np.array(batch.column("id").to_pylist(), dtype=object)
            by_id = np.argsort(ids, kind="stable")
            scores = vx.unit_rows(batch.column("vector"), width) @ queries.T
            source = named.dictionary_encode()
            codes = source.indices.fill_null(-1).to_numpy(zero_copy_only=False)[by_id]
            for code in np.unique(codes):
                rows = by_id[codes == code]
                q, r = best_rows(scores[rows], cut)
                r = rows[r]
                columns = [ids_of.take(pa.array(q)), named.take(pa.array(r)), pa.array(ids[r], pa.string()), pa.array(scores[r, q])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "source_name", "id", "cosine"])

    rows = corpus.where(vx.is_valid(F.col("vector"), width)).select("source_name", "id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, out)


def vector_candidates(corpus: DataFrame, queries: DataFrame, cut: int) -> DataFrame:
    """The best ``cut`` of each source by cosine with vector_rank from 1. Rows without a vector of the queries' width are none.

    One pass over the corpus for each block of queries; what a batch sends on is
    ranked again by Spark, which keeps no more than ``cut`` before it shuffles.
    """
    ship_code(corpus.sparkSession)
    asked = queries.select("query_id", "query_vector")
    found = None
    for block in blocks(asked):
        near = _nearest(corpus, block, cut, queries.schema["query_id"].dataType)
        found = near if found is None else found.unionByName(near)
    rank, _ = _rank(["query_id", "source_name"], "cosine", cut)
    return found.withColumn("vector_rank", rank).where(F.col("vector_rank") <= cut)


def search_vector(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k over all sources by cosine; score is the cosine, bm25 is null."""
    best = vector_candidates(corpus, queries, _checked(k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("cosine", PLACES).desc(), "source_name", "id"))
    top = best.withColumn("rank", place).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "source_name", "id", F.col("cosine").alias("score"), "cosine", F.lit(None).cast("double").alias("bm25"))


@dataclass
class TermIndex:
    """What keyword search reads: ``lengths`` (source_name, id, dl) and ``postings`` (source_name, id, dl, term, tf)."""

    lengths: DataFrame
    postings: DataFrame

    @classmethod
    def over(cls, counted: DataFrame) -> TermIndex:
        """From (source_name, id, dl, term, tf) with one row of ``LENGTH`` for each chunk."""
        columns = counted.select("source_name", "id", "dl", "term", "tf")
        return cls(columns.where(F.col("term") == LENGTH).select("source_name", "id", "dl"), columns.where(F.col("term") != LENGTH))

    @classmethod
    def of(cls, corpus: DataFrame, queries: DataFrame) -> TermIndex:
        """Made for these queries from texts that were not indexed when they were written: their words alone, in one pass."""
        scratch = Scratch(corpus.sparkSession, "terms")
        wanted = query_terms(queries).select("term").unionByName(corpus.sparkSession.createDataFrame([(LENGTH,)], "term string")).distinct()
        return cls.over(scratch.write(count_terms(corpus, ["source_name", "id"], wanted)))

    def statistics(self) -> DataFrame:
        return self.lengths.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))


def count_terms(corpus: DataFrame, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(keys, dl, term, tf) of a corpus's texts, or of the wanted (term) alone; each chunk also has one row of ``LENGTH``."""
    rows = corpus.select(*keys, tx.tokens(F.col("text")).alias("_t"))
    rows = rows.select(*keys, F.size("_t").alias("dl"), F.explode(F.array_append("_t", F.lit(LENGTH))).alias("term"))
    rows = rows if wanted is None else rows.join(wanted, "term", "left_semi")
    return rows.groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query_text")))).alias("term"))


def bm25_statistics(corpus: DataFrame) -> DataFrame:
    """Per source: documents, and mean length in terms. Empty texts count."""
    return TermIndex(corpus.select("source_name", "id", F.size(tx.tokens(F.col("text"))).alias("dl")), corpus).statistics()


def bm25_scores(index: TermIndex, queries: DataFrame) -> DataFrame:
    """(query_id, source_name, id, bm25) of chunks with a term of the query.

    Statistics are per source and over the whole corpus. The words of a few queries
    are a filter that reaches the scan of the postings; those of many are joined.
    """
    terms, few = query_terms(queries), queries.select("query_id", F.array_distinct(tx.tokens(F.col("query_text"))).alias("t")).limit(FEW_QUERIES + 1).collect()
    if len(few) <= FEW_QUERIES:  # one small table of their words, which no job has to make
        pairs = [(r["query_id"], t) for r in few for t in r["t"] or []]
        terms = queries.sparkSession.createDataFrame(pairs, terms.schema)
        listed = list(dict.fromkeys(t for _, t in pairs))[: LISTED_TERMS + 1]
    else:
        listed = [r["term"] for r in terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    tf = index.postings
    tf = tf.where(F.col("term").isin(*listed)) if len(listed) <= LISTED_TERMS else tf.join(terms.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("source_name", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    scored = tf.join(df, ["source_name", "term"]).join(index.statistics(), "source_name").withColumn("part", idf * weight)
    return scored.join(terms, "term").groupBy("query_id", "source_name", "id").agg(F.sum("part").alias("bm25"))


def lexical_candidates(corpus: DataFrame, queries: DataFrame, cut: int, index: TermIndex | None = None) -> DataFrame:
    """The best ``cut`` of each source by bm25 with lexical_rank from 1, from the index of the corpus if it has one."""
    rank, _ = _rank(["query_id", "source_name"], "bm25", cut)
    return bm25_scores(index or TermIndex.of(corpus, queries), queries).withColumn("lexical_rank", rank).where(F.col("lexical_rank") <= cut)


def fuse(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both rankings side by side with their reciprocal rank fusion; what one lacks is null."""
    keys = ["query_id", "source_name", "id"]
    both = vector.select(*keys, "vector_rank", "cosine").join(lexical.select(*keys, "lexical_rank", "bm25"), keys, "full_outer")
    part = lambda c: F.coalesce(1 / (RRF_OFFSET + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", part("vector_rank") + part("lexical_rank"))


def _kept(pool: DataFrame, queries: DataFrame) -> tuple[DataFrame, int]:
    """The candidates, computed once, and how many have no cosine: a local table if they are those of a few queries, else a stored one."""
    spark = pool.sparkSession
    if len(queries.select("query_id").limit(FEW_QUERIES + 1).collect()) <= FEW_QUERIES:
        rows = pool.limit(FEW_CANDIDATES + 1).toArrow()
        if len(rows) <= FEW_CANDIDATES:
            return spark.createDataFrame(rows, pool.schema), rows["cosine"].null_count
    stored = Scratch(spark, "pool").write(pool)
    return stored, stored.where(F.col("cosine").isNull()).count()


def search_hybrid(corpus: DataFrame, queries: DataFrame, k: int, index: TermIndex | None = None) -> DataFrame:
    """Top k by cosine plus a bounded keyword boost; fusion breaks ties.

    Candidates are the best of both rankers per source. Every candidate gets its
    exact cosine, so a keyword match that is far away stays below near vectors.
    """
    cut = pool_size(_checked(k))
    pool = fuse(vector_candidates(corpus, queries, cut), lexical_candidates(corpus, queries, cut, index))
    pool, n = _kept(pool, queries)
    known = pool.where(F.col("cosine").isNotNull())
    # What only its words have found gets its cosine by two joins on ids; all else has it from the matrix product.
    missing = pool.where(F.col("cosine").isNull()).drop("cosine")
    if n:
        found = F.broadcast(missing) if n <= BROADCAST_POOL else missing
        missing = corpus.select("source_name", "id", "vector").join(found, ["source_name", "id"])
        missing = missing.join(queries.select("query_id", "query_vector"), "query_id").withColumn("cosine", vx.cosine(F.col("vector"), F.col("query_vector")))
        known = known.unionByName(missing.select(*known.columns))
    scored = known.withColumn("score", F.col("cosine") + vx.lexical_boost(F.col("bm25")))
    order = [F.round("score", PLACES).desc(), F.round("rrf", PLACES).desc(), F.col("source_name"), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    top = scored.withColumn("rank", place).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "source_name", "id", "score", "cosine", "bm25")


def expand_context(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """Stitch each hit with its neighbours: context_text, context_start, context_end.

    ``hits`` and ``chunks`` have source_name, source_path, chunk_index; chunks also
    text, char_start and char_end. Overlaps are merged, a gap becomes one line end.
    One band join serves all hits. A hit without rows has no context row.
    """
    near = chunks.select("source_name", "source_path", F.col("chunk_index").alias("_i"), F.col("text").alias("_t"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    joined = hits.join(near, ["source_name", "source_path"]).where(F.abs(F.col("_i") - F.col("chunk_index")) <= radius)
    keys = hits.columns
    rows = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_t", "_s", "_e"))).alias("_rows"))
    first = F.struct(F.get("_rows", F.lit(0))["_t"].alias("t"), F.get("_rows", F.lit(0))["_s"].alias("s"), F.get("_rows", F.lit(0))["_e"].alias("e"))

    def add(acc: Column, r: Column) -> Column:
        fresh = F.substring(r["_t"], (acc["e"] - r["_s"] + 1).cast("int"), F.length(r["_t"]))
        longer = F.when(r["_s"] <= acc["e"], F.concat(acc["t"], fresh)).otherwise(F.concat(acc["t"], F.lit("\n"), r["_t"]))
        inside = r["_e"] <= acc["e"]
        return F.struct(F.when(inside, acc["t"]).otherwise(longer).alias("t"), acc["s"].alias("s"), F.greatest(acc["e"], r["_e"]).alias("e"))

    stitched = rows.withColumn("_c", F.aggregate(F.expr("slice(_rows, 2, size(_rows))"), first, add))
    return stitched.select(*keys, F.col("_c.t").alias("context_text"), F.col("_c.s").alias("context_start"), F.col("_c.e").alias("context_end"))


def search(corpus: DataFrame, query: str, embedder, sources: list[str] | None = None, k: int = 10, context_chunks: int = 0, index: TermIndex | None = None) -> DataFrame:
    """The search tool: guards, clamps, hybrid ranking and optional context.

    A blank query finds nothing and embeds nothing; k is held to 1..100 and the
    context radius to 0..5; unknown sources are ignored.
    """
    spark = corpus.sparkSession
    k, radius = max(1, min(k, MAX_K)), max(0, min(context_chunks, MAX_CONTEXT))
    corpus = only_sources(corpus, sources)
    if not query.strip() or sources == []:
        queries = make_queries(spark, [])
    else:
        queries = make_queries(spark, [(0, query, [float(x) for x in embedder.embed([query])[0]])])
    if index is not None and sources is not None:
        index = TermIndex(only_sources(index.lengths, sources), only_sources(index.postings, sources))
    hits = F.broadcast(search_hybrid(corpus, queries, k, index))  # MAX_K rows at most
    hits = corpus.drop("vector").join(hits, ["source_name", "id"])
    if radius:
        own = hits.select("source_name", "source_path", "chunk_index")
        wide = expand_context(own.distinct(), corpus, radius)
        hits = hits.join(wide, ["source_name", "source_path", "chunk_index"], "left")
        hits = hits.withColumns({
            "text": F.coalesce("context_text", "text"), "char_start": F.coalesce("context_start", "char_start"), "char_end": F.coalesce("context_end", "char_end"),
        }).drop("context_text", "context_start", "context_end")
    return hits.orderBy("rank")
