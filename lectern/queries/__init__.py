"""Queries of the engine on the stand-in tables, each with its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("rendering", "merging", "searching", "syncing", "profiling")


def load_all():
    for name in MODULES:
        importlib.import_module(f"lectern.queries.{name}")
    from lectern.queries.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
