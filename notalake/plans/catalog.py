"""Loads every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["validation", "values", "listing", "texts", "xml", "relations", "retrieval", "profiling", "flows", "indexes", "stores", "summaries"]


def load() -> None:
    for name in MODULES:
        import_module(f"notalake.plans.{name}")
