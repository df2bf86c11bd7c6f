"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import conversations, decontam, embed_dedup, jaccard_join, langid, license_scan, line_dedup, mixing, quality, quality_rules, runs, suffix_dedup, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality": quality.op2_quality,
    "op3_mix": mixing.op3_mix,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_embed_dedup": embed_dedup.op6_embed_dedup,
    "op7_langid": langid.op7_langid,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op3_mix": mixing.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op6_embed_dedup": embed_dedup.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_decontaminate": decontam.ORACLE,
    "op11_periodic_runs": runs.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
