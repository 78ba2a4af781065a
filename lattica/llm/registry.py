"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lattica.llm import op1_pii as op1
from lattica.llm import op10_quality as op10
from lattica.llm import op2_licenses as op2
from lattica.llm import op3_decontamination as op3
from lattica.llm import op4_language_id as op4
from lattica.llm import op5_suffix_tree as op5
from lattica.llm import op6_packing as op6
from lattica.llm import op7_parity_join as op7
from lattica.llm import op8_media_chunks as op8
from lattica.llm import op9_line_dedup as op9


def queries() -> dict:
    return {
        "op1_pii_pseudonyms": op1.op1_pii_pseudonyms,
        "op2_license_scan": op2.op2_license_scan,
        "op3_benchmark_decontamination": op3.op3_benchmark_decontamination,
        "op4_language_id": op4.op4_language_id,
        "op5_suffix_tree_scores": op5.op5_suffix_tree_scores,
        "op6_best_fit_packing": op6.op6_best_fit_packing,
        "op7_parity_sketch_join": op7.op7_parity_sketch_join,
        "op8_media_chunks": op8.op8_media_chunks,
        "op9_line_dedup": op9.op9_line_dedup,
        "op10_quality_classifier": op10.op10_quality_classifier,
    }


def oracle_sql() -> dict:
    return {"op2_license_scan": op2.ORACLE, "op3_benchmark_decontamination": op3.ORACLE, "op9_line_dedup": op9.ORACLE}
