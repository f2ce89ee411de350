"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from loomwork.llm import bpe, decontaminate, html_text, katz, language_id, near_dedup, nearest, quality_model, quality_rules, sharding, token_counts, version_tree, whitening

QUERIES = {
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op5_html_text": html_text.op5_html_text,
    "op10_edit_token_counts": token_counts.op10_edit_token_counts,
    "op8_kd_sharding": sharding.op8_kd_sharding,
    "op1_katz_scores": katz.op1_katz_scores,
    "op2_language_id": language_id.op2_language_id,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_model": quality_model.op7_quality_model,
    "op4_bpe_round_trip": bpe.op4_bpe_round_trip,
    "op11_nearest": nearest.op11_nearest,
    "op13_whitening": whitening.op13_whitening,
    "op12_version_tree": version_tree.op12_version_tree,
}

ORACLES: dict[str, str] = {
    "op3_near_dedup": near_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_nearest": nearest.ORACLE,
    "op12_version_tree": version_tree.ORACLE,
}
