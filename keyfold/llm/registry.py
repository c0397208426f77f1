"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage
MODULES = {
    "op1_jaccard_join": "jaccard",
    "op2_token_counts": "transducer",
    "op4_language_id": "language",
    "op5_pii": "pii",
    "op6_bpe": "bpe",
    "op3_line_dedup": "lines",
    "op7_decontaminate": "decontaminate",
    "op8_toxicity": "toxicity",
    "op9_embedding_dedup": "vectors",
    "op10_chat_format": "chat",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
