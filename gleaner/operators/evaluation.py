"""Retrieval quality: golden queries, recall@k, MRR and negative queries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.errors import EvalError
from gleaner.functions import text as tx
from gleaner.operators.ranking import search_hybrid
from gleaner.sources.checks import PHRASE, ROWS, Faults, Key, read_toml

GOLDEN_SCHEMA = "query_id long, query_text string, expected_paths array<string>, expect_max_cosine double"
#: A query is held to the files that should be found, or to a cosine that nothing should reach.
GOLDEN = {
    "query": PHRASE,
    "expected_paths": Key("a list of paths that is not empty", ROWS.good, None),
    "expect_max_cosine": Key("a number above 0 and up to 1", lambda v: isinstance(v, (int, float)) and 0 < v <= 1, None),
}


def load_golden(spark: SparkSession, path: str | Path) -> DataFrame:
    """Queries of a TOML file, numbered from 0."""
    faults = Faults(path)
    entries = faults.read(read_toml(path, EvalError), {"queries": ROWS})["queries"] or []
    rows = [faults.read(e, GOLDEN, f"queries[{i}]") for i, e in enumerate(entries)]
    for i, (entry, row) in enumerate(zip(entries, rows, strict=True)):
        if isinstance(entry, dict) and ("expected_paths" in entry) == ("expect_max_cosine" in entry):
            faults.add(f"queries[{i}]", "should have either expected_paths or expect_max_cosine")
    faults.stop(EvalError)
    golden = [(i, r["query"], r["expected_paths"] and [str(p) for p in r["expected_paths"]], r["expect_max_cosine"] and float(r["expect_max_cosine"])) for i, r in enumerate(rows)]
    return spark.createDataFrame(golden, GOLDEN_SCHEMA)


def query_results(golden: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """One row per golden query: best_rank and hit_path of the first expected file, max_cosine, passed.

    Files rank by their best chunk. All queries and the corpus meet in one plan.
    """
    hits = search_hybrid(corpus, queries, max(4 * k, 20)).join(corpus.select("source_name", "id", "source_path"), ["source_name", "id"])
    peak = hits.groupBy("query_id").agg(F.max(F.coalesce("cosine", F.lit(0.0))).alias("max_cosine"))
    files = hits.groupBy("query_id", "source_path").agg(F.min("rank").alias("chunk_rank"))
    files = files.withColumn("file_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_rank"))).where(F.col("file_rank") <= k)
    expected = golden.where(F.col("expected_paths").isNotNull()).select("query_id", F.explode("expected_paths").alias("expected"))
    matched = files.join(expected, "query_id").where(tx.path_matches(F.col("source_path"), F.col("expected")))
    best = matched.groupBy("query_id").agg(F.min("file_rank").alias("best_rank"), F.min_by("source_path", "file_rank").alias("hit_path"))
    out = golden.join(best, "query_id", "left").join(peak, "query_id", "left").withColumn("max_cosine", F.coalesce("max_cosine", F.lit(0.0)))
    negative = F.col("expect_max_cosine").isNotNull()
    passed = F.when(negative, F.col("max_cosine") < F.col("expect_max_cosine")).otherwise(F.col("best_rank").isNotNull())
    return out.select("query_id", negative.alias("negative"), "best_rank", "hit_path", "max_cosine", passed.alias("passed"))


def report(results: DataFrame) -> DataFrame:
    """recall, mrr (0 without positive queries), and negatives in total and passed."""
    positive = ~F.col("negative")
    share = lambda value: F.coalesce(F.avg(F.when(positive, value)), F.lit(0.0))
    return results.agg(
        share(F.when(F.col("best_rank").isNotNull(), 1.0).otherwise(0.0)).alias("recall"),
        share(F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))).alias("mrr"),
        F.count_if(F.col("negative")).alias("negatives"), F.count_if(F.col("negative") & F.col("passed")).alias("negatives_passed"),
    )


def evaluate(golden: DataFrame, corpus: DataFrame, embedder, k: int = 5) -> DataFrame:
    if golden.isEmpty():
        raise EvalError("no golden queries")
    queries = golden.select("query_id", "query_text", embedder.embed_column(F.col("query_text")).cast("array<double>").alias("query_vector"))
    return query_results(golden, queries, corpus, k)
