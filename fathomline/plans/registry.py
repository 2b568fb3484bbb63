"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "G6_company_score"
_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``f(spark, sf_dir)`` under ``name`` with its oracle SQL."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return keep


def q(name: str, build: Callable, sql: str | None = None) -> None:
    """Register ``build(tables)``; views that ``sql`` names are defined before it."""
    from fathomline.sources.tables import Tables, with_views

    register(name, with_views(sql) if sql else None)(lambda spark, sf_dir: build(Tables(spark, sf_dir)))


def _load() -> None:
    from importlib import import_module

    for plan in PLANS:
        import_module(f"fathomline.plans.{plan}")


PLANS = ("relational", "aggregates", "scores", "entities", "texts", "feeds", "details", "records", "listings", "functions", "runs")


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE
