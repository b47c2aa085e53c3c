"""Queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import importlib

#: Query name -> module with ``query(spark, sf_dir)`` and, where SQL can express it, ``ORACLE_SQL``.
MODULES = {
    "op1_licenses": "licenses",
    "op2_mixing": "mixing",
    "op3_secrets": "secrets",
    "op4_sharding": "sharding",
    "op5_substrings": "substrings",
    "op6_decontamination": "decontamination",
    "op7_tokens": "tokens",
    "op8_simhash": "simhash",
    "op9_langid": "langid",
    "op10_nearest": "nearest",
}


def _module(name: str):
    return importlib.import_module(f"quern.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
