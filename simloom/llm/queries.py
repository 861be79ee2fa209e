"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from simloom.llm import op1_html, op2_passages, op3_jaccard, op4_langid, op5_decontaminate, op6_mixing, op7_secrets, op8_ann, op9_suffix, op10_lines, op11_audit, op12_urls, op13_negatives


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html.op1_html_extraction,
        "op2_substring_dedup": op2_passages.op2_substring_dedup,
        "op3_jaccard_join": op3_jaccard.op3_jaccard_join,
        "op4_language_id": op4_langid.op4_language_id,
        "op5_decontamination": op5_decontaminate.op5_decontamination,
        "op6_mixing": op6_mixing.op6_mixing,
        "op7_secret_scan": op7_secrets.op7_secret_scan,
        "op8_nearest_neighbours": op8_ann.op8_nearest_neighbours,
        "op9_suffix_dedup": op9_suffix.op9_suffix_dedup,
        "op10_line_dedup": op10_lines.op10_line_dedup,
        "op11_filter_audit": op11_audit.op11_filter_audit,
        "op12_url_filter": op12_urls.op12_url_filter,
        "op13_hard_negatives": op13_negatives.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op5_decontamination": op5_decontaminate.ORACLE, "op10_line_dedup": op10_lines.ORACLE, "op11_filter_audit": op11_audit.ORACLE, "op13_hard_negatives": op13_negatives.ORACLE}
