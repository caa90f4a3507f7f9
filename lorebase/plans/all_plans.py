"""Imports every module of this package that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "conversations", "graph", "traces", "bookkeeping", "rules", "streams", "context", "citations", "versions", "planning", "memory", "elements", "questions", "knowledge", "payloads", "outcomes", "records", "extraction", "indexes", "adaptive", "sources", "saved", "comparisons")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"lorebase.plans.{name}")
