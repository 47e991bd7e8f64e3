"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from skein.llm import bpe, decontamination, html_extract, langid, mixing, near_join, quality, resampling, suffix_dedup, toxicity, training_order, urls, vector_codes


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_near_join": near_join.op2_near_join,
        "op3_url_filters": urls.op3_url_filters,
        "op4_training_order": training_order.op4_training_order,
        "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language_id": langid.op7_language_id,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_bpe": bpe.op9_bpe,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op11_mixing": mixing.op11_mixing,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL,
        "op2_near_join": near_join.OP2_SQL,
        "op3_url_filters": urls.OP3_SQL,
        "op5_suffix_array_dedup": suffix_dedup.OP5_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op11_mixing": mixing.OP11_SQL,
        "op12_importance_resampling": resampling.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
