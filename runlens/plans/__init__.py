"""Bindings of the operators to the given tables."""

from __future__ import annotations

import importlib

from .registry import QUERIES

MODULES = [
    "jobs", "columns", "text", "scans", "outputs", "joins", "aggregates", "windows", "steps",
    "graphs", "observing", "rules", "streams", "userfuncs",
]


def all_queries():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES
