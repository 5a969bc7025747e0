"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern of a word: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast hint behind a checked row count; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """Columns ``needed`` beside a struct ``row`` of all, so that no name can clash with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)
