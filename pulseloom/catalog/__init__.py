"""Named queries over the shared test tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from pulseloom.catalog.base import ORACLE, QUERIES, Query

_MODULES = ("signals", "analysis", "incidents", "maintenance", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"pulseloom.catalog.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
