"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import collocations, decontaminate, html_extract, langid, line_dedup, media, minhash, oracles, packing, secret_scan, sharding, token_shards, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    each = (
        html_extract.op1_tag_path_text, media.op2_tar_media_columns, minhash.op3_bbit_minhash, sharding.op4_virtual_slot_shards, token_shards.op5_feistel_token_shards,
        packing.op6_best_fit_packing, langid.op7_evidence_language, langid.op7_pages_language, decontaminate.op8_benchmark_decontamination, secret_scan.op9_blob_ledger_secrets, line_dedup.op10_distinct_site_lines,
        warc.op11_zstd_warc, collocations.op12_merged_sketch_collocations, whitening.op13_double_double_whitening,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op3_bbit_minhash": oracles.NEAR_COPIES, "op8_benchmark_decontamination": oracles.CONTAMINATION, "op9_blob_ledger_secrets": oracles.SECRETS, "op10_distinct_site_lines": oracles.LINES, "op11_zstd_warc": oracles.ARCHIVED, "op12_merged_sketch_collocations": oracles.COLLOCATIONS}
