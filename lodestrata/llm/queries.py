"""The corpus operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, license_scan, line_dedup, packing, quality_cnn, quality_rules, simhash, token_counts, token_files

QUERIES = {
    "op1_quality_cnn": quality_cnn.op1,
    "op2_license_scan": license_scan.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_token_files": token_files.op4,
    "op5_simhash": simhash.op5,
    "op6_token_counts": token_counts.op6,
    "op7_packing": packing.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_language": language.op9,
    "op10_line_dedup": line_dedup.op10,
}

ORACLES = {"op8_decontaminate": decontaminate.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
