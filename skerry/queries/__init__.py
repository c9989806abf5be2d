"""Registered queries: name -> callable(spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("hierarchy", "briefs", "tables", "graphs", "geometry", "records", "lineage", "health")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").SQL.items()}
