"""All queries of the library and their SQL."""

from __future__ import annotations

import importlib

from .fixtures import Views, with_views

_FAMILIES = ("evaluation", "tables", "storage", "rasters", "learning")
_queries: dict = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(views)`` under ``name``, with SQL over the views."""

    def add(f):
        _queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _sql[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"{__package__}.{family}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
