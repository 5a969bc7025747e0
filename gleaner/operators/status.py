"""Outcomes of index runs: histograms, failure groups and the status report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx

#: What can happen to a file in a run.
STATUSES = ("embedded", "unchanged", "empty", "deleted", "skipped_oversize", "skipped_unreadable", "error")
CHANGES = ("embedded", "deleted", "empty")
FAILURES = ("error", "skipped_unreadable")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("files")).orderBy("status")


def has_changes(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_or(F.col("status").isin(*CHANGES)), F.lit(False)).alias("changed"))


def failure_groups(results: DataFrame, order: str) -> DataFrame:
    """Failures by their error (else status), in order of first appearance.

    ``order`` names the column that orders the files of the run.
    """
    failed = results.where(F.col("status").isin(*FAILURES))
    key = F.coalesce(F.when(F.col("error") != "", F.col("error")), F.col("status"))
    grouped = failed.groupBy(key.alias("error")).agg(
        F.count(F.lit(1)).alias("count"), F.min_by("path", order).alias("example_path"), F.min(order).alias("first_seen"))
    return grouped.orderBy("first_seen")


def chunk_counts(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per table of ``catalog`` (name), empty tables included."""
    counted = chunks.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.select("name").distinct().join(counted, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def index_status(counts: DataFrame, configured: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """One row per indexed or configured source with its freshness and total_chunks.

    ``runs`` has name, last_attempt, last_run, last_change, last_error and
    embedding_model; a source without a last_run was never indexed.
    """
    names = counts.select("name").unionByName(configured.select("name")).distinct()
    out = names.join(counts, "name", "left").join(runs, "name", "left")
    out = out.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    out = out.withColumn("last_run_age_seconds", tx.age_seconds(F.col("last_run"), F.to_timestamp(F.lit(now))))
    return out.withColumn("total_chunks", F.sum("chunk_count").over(Window.partitionBy(F.lit(0)))).orderBy("name")


def recent_runs(runs: DataFrame, keep_runs: int) -> DataFrame:
    """The last ``keep_runs`` rows of each source_name by run."""
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(F.col("run").desc()))
    return runs.withColumn("_r", place).where(F.col("_r") <= keep_runs).drop("_r")


def diff_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do with each path of files (path, hash, oversize) or stored (path, hash).

    A path that is gone is deleted; an oversize one keeps its rows.
    """
    old = stored.select("path", F.col("hash").alias("_old"))
    both = files.withColumn("_here", F.lit(True)).join(old, "path", "full_outer")
    action = (
        F.when(F.col("_here").isNull(), "deleted").when(F.col("oversize"), "skipped_oversize")
        .when(F.col("hash") == F.col("_old"), "unchanged").when(F.col("_old").isNull(), "new").otherwise("changed")
    )
    return both.select("path", action.alias("action"))
