"""Loads every module of this subpackage that registers a query."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ["quality_rules", "url_rules", "chat_format", "secret_scan", "line_dedup", "license_scan", "token_files", "packing", "jaccard_join", "decontaminate", "collocations", "hard_negatives", "katz"]

for _name in MODULES:
    import_module(f"notalake.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
