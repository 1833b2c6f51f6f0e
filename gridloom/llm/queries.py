"""Queries and oracle SQL of the text operators."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that has a function of that name, and perhaps <NAME>_SQL
MODULES = {
    "op1_quality_classifier": "quality_model",
    "op2_simhash": "simhash",
    "op3_substring_dedup": "substring_dedup",
    "op4_decontamination": "decontaminate",
    "op5_quality_rules": "quality_rules",
    "op6_main_text": "html_text",
    "op7_toxicity": "toxicity",
    "op8_secret_scan": "secrets",
    "op9_line_dedup": "line_dedup",
    "op10_bpe": "bpe",
}


def queries() -> dict:
    found = {name: getattr(import_module(f"gridloom.llm.{module}"), name) for name, module in MODULES.items()}
    found["pipeline"] = import_module("corpus_pipeline").run
    return found


def oracle_sql() -> dict:
    found = {}
    for name, module in MODULES.items():
        if sql := getattr(import_module(f"gridloom.llm.{module}"), f"{name.upper()}_SQL", None):
            found[name] = sql
    return found
