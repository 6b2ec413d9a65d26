"""The registered queries of the metadata operators, with their SQL."""

from __future__ import annotations

from . import lists, retrieval, sheet

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (sheet, lists, retrieval):
    QUERIES |= _part.Q
    ORACLE_SQL |= _part.O
