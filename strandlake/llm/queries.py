"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Module and function of each query.
PLACES = {
    "op1_toxicity": "toxicity",
    "op2_simhash": "simhash",
    "op3_html": "html",
    "op4_decontamination": "decontamination",
    "op5_sentencepiece": "pieces",
    "op6_token_counts": "token_counts",
    "op7_quality": "quality",
    "op8_lm_scoring": "lm_scoring",
    "op9_sharding": "sharding",
    "op10_telephony": "telephony",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"strandlake.llm.{module}"), name) for name, module in PLACES.items()}


def oracle_sql() -> dict[str, str]:
    from strandlake.llm import oracles

    return oracles.SQL
