"""Views over the given tables, and the registered queries with their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("alignments", "trees", "scoring", "traces", "files", "search", "streams")


def _registries():
    for name in _MODULES:
        yield importlib.import_module(f"cladeframe.catalog.{name}").registry


def all_queries() -> dict:
    return {name: fn for r in _registries() for name, fn in r.queries.items()}


def all_sql() -> dict:
    return {name: sql for r in _registries() for name, sql in r.sql.items()}
