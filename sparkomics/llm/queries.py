"""The registered queries of this package and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, sharding, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_html_text": html_text.op4_html_text,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op7_mixing": mixing.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
