"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ["row_rules", "table_rules", "result_queries", "rule_tables", "profiles", "storage", "streams"]


def load_all():
    """Import every query module; returns (queries, sql)."""
    for name in MODULES:
        importlib.import_module(f"queries.{name}")
    base = importlib.import_module("queries.base")
    return base.QUERIES, base.SQL
