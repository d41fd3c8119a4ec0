"""The queries of this subpackage by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, licenses, neighbours, packing, simhash, token_binary, token_counts, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_nearest_neighbours": neighbours.op5_nearest_neighbours,
    "op6_language_id": langid.op6_language_id,
    "op7_token_binary": token_binary.op7_token_binary,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_url_filters": url_filters.op10_url_filters,
}

ORACLES: dict[str, str] = {
    "op8_license_scan": licenses.OP8_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
}
