"""Registered queries over the star-schema tables, each with its checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("reports_shipping", "reports_sales", "domain", "primitives")


def load():
    """All queries and all checking SQL, by key."""
    for name in MODULES:
        import_module(f"bizlake.catalog.{name}")
    from bizlake.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
