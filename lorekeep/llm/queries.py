"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import clustering, codes, decontaminate, html_extract, language_model, licenses, media, mixing, quality, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_progressive_jpeg": media.op2_progressive_jpeg,
    "op3_html_crf": html_extract.op3_html_crf,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality_knn": quality.op9_quality_knn,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_dual_tree_lloyd": clustering.op11_dual_tree_lloyd,
    "op12_filtering_codes": codes.op12_filtering_codes,
    "op13_deleted_interpolation": language_model.op13_deleted_interpolation,
}

ORACLE_SQL = {
    "op1_license_scan": licenses.ORACLE_SQL,
    "op4_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op6_source_mix": mixing.ORACLE_SQL,
    "op11_dual_tree_lloyd": clustering.ORACLE_SQL,
    "op12_filtering_codes": codes.ORACLE_SQL,
}
