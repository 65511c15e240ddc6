"""The training-data queries and their oracles, as the entry module registers them."""

from __future__ import annotations

from tidelog.llm import decontamination, jaccard_join, licenses, packing, pii, preferences, quality, token_counts, url_filter, winnowing

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_winnowing": winnowing.op4_winnowing,
    "op5_preferences": preferences.op5_preferences,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_licenses": licenses.op7_licenses,
    "op8_pii": pii.op8_pii,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op5_preferences": preferences.OP5_SQL,
    "op7_licenses": licenses.OP7_SQL,
}
