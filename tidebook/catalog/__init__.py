"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

_FAMILIES = (
    "dedup", "projections", "joins", "aggregates", "windows", "topk_sets", "scalars", "patterns",
    "options", "trades", "scoring", "funds", "reports", "sources", "streams",
)


def load():
    registry = importlib.import_module("tidebook.catalog.registry")
    for family in _FAMILIES:
        importlib.import_module(f"tidebook.catalog.{family}")
    return registry
