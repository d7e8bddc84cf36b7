"""All queries for the reference's own operators."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in ("q_scoring", "q_relational", "q_records", "q_more"):
    _m = importlib.import_module(f"lodestrata.plans.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
