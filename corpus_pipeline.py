"""Documents to training sequences: filter, deduplicate, mix and pack.

Each stage gets what the one before it kept, written as Parquet and read again,
and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import mixing, neardup, packing, quality, substring
from gleaner.llm.common import table
from gleaner.runtime import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject. Nulls are scored as empty texts."""
    return quality.keep_good_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each word cut out that a repeated window covers."""
    return substring.remove_repeats_from(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier is trained and the texts are tokenised, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
