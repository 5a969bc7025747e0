"""The chunk table: its columns, what makes a table stale, and tolerant reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("source_path", T.StringType(), False),
    T.StructField("file_hash", T.StringType(), False), T.StructField("chunk_index", T.LongType(), False),
    T.StructField("char_start", T.LongType(), False), T.StructField("char_end", T.LongType(), False),
    T.StructField("heading_path", T.StringType(), False), T.StructField("text", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), False), T.StructField("note_date", T.DateType()),
    T.StructField("status", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    T.StructField("kind", T.StringType(), False),
])
#: Columns that older tables lack and what a reader sees instead.
DEFAULTS = {"note_date": None, "status": None, "tags": [], "kind": "text"}


def missing_columns(df: DataFrame) -> list[str]:
    """Expected columns that a table lacks, sorted. Extra ones are fine."""
    return sorted(set(CHUNK_SCHEMA.names) - set(df.columns))


def _default(name: str) -> Column:
    kind = CHUNK_SCHEMA[name].dataType
    value = DEFAULTS[name]
    return F.array().cast(kind.simpleString()) if value == [] else F.lit(value).cast(kind)


def read_chunks(df: DataFrame) -> DataFrame:
    """A table of any version as CHUNK_SCHEMA columns, extra columns behind them."""
    columns = []
    for field in CHUNK_SCHEMA:
        if field.name not in df.columns:
            columns.append(_default(field.name).alias(field.name))
        elif field.name == "kind":
            columns.append(F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit("text")).alias("kind"))
        elif field.name == "note_date" and dict(df.dtypes)["note_date"] != "date":
            columns.append(F.lit(None).cast("date").alias("note_date"))
        elif field.name == "tags":
            columns.append(F.coalesce("tags", _default("tags")).alias("tags"))
        elif dict(df.dtypes)[field.name] == field.dataType.simpleString():
            columns.append(F.col(field.name))
        else:
            columns.append(F.col(field.name).cast(field.dataType.simpleString()).alias(field.name))
    return df.select(*columns, *[F.col(c) for c in df.columns if c not in CHUNK_SCHEMA.names])


def check_width(df: DataFrame, width: int) -> None:
    """Raise if a vector to be written has another width than the database's."""
    bad = df.where(F.size("vector") != width).select(F.size("vector").alias("n")).first()
    if bad:
        raise ValueError(f"vector dim mismatch (expected {width}, got {bad['n']})")
