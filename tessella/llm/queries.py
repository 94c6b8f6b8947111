"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jpeg, language_id, license_scan, line_dedup, mixing, periodic_runs, segmentation, shingle_join, target_encoding, token_counts, topk_search, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_progressive_jpeg": jpeg.op2_progressive_jpeg,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_shingle_join": shingle_join.op4_shingle_join,
    "op5_segmentation": segmentation.op5_segmentation,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_wavelet": wavelet.op10_wavelet,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_target_encoding": target_encoding.op12_target_encoding,
    "op13_license_scan": license_scan.op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op9_topk_search": topk_search.ORACLE,
    "op12_target_encoding": target_encoding.ORACLE,
}
