"""Registered queries over the given tables, with their SQL for the result check."""

from __future__ import annotations

from millrace.plans.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
