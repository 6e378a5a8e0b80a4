"""Queries over the derived research tables."""

from __future__ import annotations

import importlib

MODULES = (
    "selection", "ingestion", "factor", "series", "learning", "performance", "screening", "certification", "content", "files", "incremental",
)


def all_queries():
    """All registered queries by name."""
    from pitgrid.plans import registry

    for m in MODULES:
        importlib.import_module(f"pitgrid.plans.{m}")
    return registry.QUERIES
