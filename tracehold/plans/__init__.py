"""Registered queries; importing the plan modules fills the registry."""

from __future__ import annotations

from importlib import import_module

# The plan modules.
MODULES = ["ingest", "detection", "correlation", "behaviour", "intelligence", "learning", "streams"]


def _load():
    for name in MODULES:
        import_module(f"tracehold.plans.{name}")


def all_queries() -> dict:
    _load()
    from tracehold.plans.registry import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    from tracehold.plans.registry import ORACLES

    return dict(ORACLES)
