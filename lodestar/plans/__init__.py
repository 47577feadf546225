"""Query compositions over the driver's tables, each with its SQL."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "matching", "graph", "sources", "silver", "reports", "gates")


def load() -> None:
    """Import every module of queries, so that each registers its own."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
