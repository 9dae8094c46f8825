"""Queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm import decontaminate, html_text, line_dedup, mixing, near_dedup, quality, quotes, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quotes": quotes.op3_quotes,
    "op4_mixing": mixing.op4_mixing,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_secrets": secrets.op7_secrets,
    "op8_html_text": html_text.op8_html_text,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
