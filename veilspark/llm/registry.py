"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import archive, brown, decontaminate, htmltext, importance, langid, mixing, quality, recompress, runs, simhash, suffixes, tokens

QUERIES = {
    "op1_simhash_dedup": simhash.simhash_query,
    "op2_quality_rules": quality.quality_query,
    "op3_repair_tokens": tokens.tokens_query,
    "op4_spaced_seed_decontamination": decontaminate.decontaminate_query,
    "op5_brown_lm": brown.lm_query,
    "op6_recompression_dedup": recompress.substring_query,
    "op7_tree_model_html": htmltext.html_query,
    "op8_arc_to_warc": archive.archive_query,
    "op9_mix_sources": mixing.mix_query,
    "op10_suffix_sort_dedup": suffixes.suffix_query,
    "op11_importance_resampling": importance.importance_query,
    "op12_periodic_runs": runs.runs_query,
    "op13_byte_cnn_language": langid.language_query,
}

ORACLES = {
    "op8_arc_to_warc": archive.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
}
