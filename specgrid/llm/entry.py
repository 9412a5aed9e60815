"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from specgrid.llm import ann, decontaminate, fim, html_text, langid, lexical, line_dedup, mixing, ngram_join, preference, quality, sharding, toxicity

QUERIES = {
    "op1_cumulative_link": quality.op1_cumulative_link,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_positional_index": decontaminate.op3_positional_index,
    "op4_nearest_centroid": langid.op4_nearest_centroid,
    "op5_count_vector_rtree": ngram_join.op5_count_vector_rtree,
    "op6_site_template": html_text.op6_site_template,
    "op7_cross_polytope": ann.op7_cross_polytope,
    "op8_pivotal_mix": mixing.op8_pivotal_mix,
    "op9_preference_format": preference.op9_preference_format,
    "op10_noisy_channel": toxicity.op10_noisy_channel,
    "op11_wavelet_fim": fim.op11_wavelet_fim,
    "op12_presence_mask": lexical.op12_presence_mask,
    "op13_cuckoo_lines": line_dedup.op13_cuckoo_lines,
}
ORACLE_SQL = {
    "op9_preference_format": preference.OP9_SQL,
    "op11_wavelet_fim": fim.OP11_SQL,
    "op12_presence_mask": lexical.OP12_SQL,
    "op13_cuckoo_lines": line_dedup.OP13_SQL,
}
