"""Registered catalog queries and the SQL that checks them."""

from __future__ import annotations

from filmroll.plans import queries as _queries

QUERIES = _queries.QUERIES
ORACLE_SQL = _queries.ORACLE_SQL
