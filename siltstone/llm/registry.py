"""Queries and SQL of this folder, by name."""

from __future__ import annotations

from . import chat_format, conversation_repair, decontamination, html_text, kneser_ney, line_dedup, mixing_lm, packing, quality_rules, secret_scan, sharding, simhash, whitening

QUERIES = {
    "op1_line_frequency_rules": quality_rules.op1_line_frequency_rules,
    "op2_chat_segments": chat_format.op2_chat_segments,
    "op3_simhash_pivots": simhash.op3_simhash_pivots,
    "op4_tree_scored_text": html_text.op4_tree_scored_text,
    "op5_min_bin_slack": packing.op5_min_bin_slack,
    "op6_context_mixing_scores": mixing_lm.op6_context_mixing_scores,
    "op7_benchmark_containment": decontamination.op7_benchmark_containment,
    "op8_site_spread_lines": line_dedup.op8_site_spread_lines,
    "op9_kneser_ney_quality": kneser_ney.op9_kneser_ney_quality,
    "op10_hash_tree_shards": sharding.op10_hash_tree_shards,
    "op11_secret_spans": secret_scan.op11_secret_spans,
    "op12_cost_layers": conversation_repair.op12_cost_layers,
    "op13_chan_whitening": whitening.op13_chan_whitening,
}

ORACLE_SQL = {
    "op1_line_frequency_rules": quality_rules.OP1_SQL,
    "op2_chat_segments": chat_format.OP2_SQL,
    "op7_benchmark_containment": decontamination.OP7_SQL,
    "op8_site_spread_lines": line_dedup.OP8_SQL,
    "op11_secret_spans": secret_scan.OP11_SQL,
}
