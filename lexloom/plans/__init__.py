"""Registered queries of the core library."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("order_queries", "hierarchy_queries", "element_queries")


def _load():
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from lexloom.plans import registry

    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict:
    return dict(_load().SQL)
