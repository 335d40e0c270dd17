"""Queries of the operators in this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_minhash": "minhash",
    "op2_quality": "quality",
    "op3_rules": "rules",
    "op4_contamination": "contamination",
    "op5_chat": "chat",
    "op6_byte_bpe": "bpe",
    "op7_substring": "substring",
    "op8_licences": "licences",
    "op9_suffix_array": "suffix",
    "op10_urls": "urls",
}


def queries() -> dict:
    return {name: import_module(f"weft.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"weft.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
