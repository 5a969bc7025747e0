"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import chat, forest, licenses, mixing, neardup, packing, pivots, quality, sharding, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_pivot_search": pivots.op10_pivot_search,
    "op1_shard_documents": sharding.op1_shard_documents,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_forest_search": forest.op4_forest_search,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_format_chats": chat.op7_format_chats,
    "op8_cut_repeats": substring.op8_cut_repeats,
    "op9_pack_sequences": packing.op9_pack_sequences,
}

ORACLE_SQL: dict[str, str] = {
    "op10_pivot_search": pivots.OP10_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op6_near_duplicates": neardup.OP6_SQL,
    "op7_format_chats": chat.OP7_SQL,
    "op8_cut_repeats": substring.OP8_SQL,
}
