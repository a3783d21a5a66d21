"""All queries of the core with their SQL."""

from __future__ import annotations

MODULES = ("catalog", "aggregates", "ranking", "textops", "retrieval", "evaluation", "changes", "pipelines", "recommendations")


def _modules():
    import importlib

    return [importlib.import_module(f"lectern.plans.{name}") for name in MODULES]


def queries():
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}


def FLAGSHIP(spark, folder):
    from lectern.plans import retrieval

    return retrieval.search_fused(spark, folder)
