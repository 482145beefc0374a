"""Queries of the language-model operators, with SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that has query() and, where SQL can express it, SQL.
MODULES = {
    "op1_simhash_near_dedup": "simhash",
    "op2_url_filter": "url_filter",
    "op3_chat_formatting": "chat",
    "op4_exact_dedup": "exact_dedup",
    "op5_source_mixing": "mixing",
    "op6_line_dedup": "line_dedup",
    "op7_substring_dedup": "substring_dedup",
    "op8_quality_rules": "quality",
    "op9_bpe_codec": "bpe",
    "op10_token_counts": "token_counts",
}


def queries() -> dict:
    import corpus_pipeline

    out = {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in (found | {"pipeline": corpus_pipeline.ORACLE_SQL}).items() if sql}
