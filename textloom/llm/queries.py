"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, jaccard_join, mixing, packing, secrets, sharding, token_files, topk_search, toxicity, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_token_files": token_files.op3_token_files,
    "op4_sharding": sharding.op4_sharding,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_html_text": html_text.op8_html_text,
    "op9_packing": packing.op9_packing,
    "op10_vector_dedup": vector_dedup.op10_vector_dedup,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": topk_search.ORACLE,
    "op2_source_mix": mixing.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op5_secret_scan": secrets.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op10_vector_dedup": vector_dedup.ORACLE,
}
