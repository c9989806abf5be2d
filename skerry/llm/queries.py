"""Registered queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_rank", "queries_links", "queries_text")

QUERIES = {k: v for m in MODULES for k, v in import_module(f"skerry.llm.{m}").QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in import_module(f"skerry.llm.{m}").SQL.items()}
