"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import alignment, decontaminate, exact_dedup, langid, lexical_search, license_scan, mixing, pii, secrets_crf, sharding, simhash, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_feistel_shards": sharding.op2_feistel_shards,
    "op3_chunk_dedup": exact_dedup.op3_chunk_dedup,
    "op4_simhash_components": simhash.op4_simhash_components,
    "op5_bm25_wand": decontaminate.op5_bm25_wand,
    "op6_pii_bootstrap": pii.op6_pii_bootstrap,
    "op7_previous_factors": suffix_dedup.op7_previous_factors,
    "op8_language_id": langid.op8_language_id,
    "language_of_pages": langid.language_of_pages,
    "op9_secret_crf": secrets_crf.op9_secret_crf,
    "op10_pareto_mix": mixing.op10_pareto_mix,
    "op11_dual_tree_search": lexical_search.op11_dual_tree_search,
    "op12_url_cascade": url_filter.op12_url_cascade,
    "op13_token_alignment": alignment.op13_token_alignment,
}
SQL: dict[str, str] = {"op3_chunk_dedup": exact_dedup.OP3_SQL, "op11_dual_tree_search": lexical_search.OP11_SQL, "op12_url_cascade": url_filter.OP12_SQL}
