"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

#: One module per operator; each has QUERIES and ORACLE_SQL.
MODULES = ("token_counts", "mixing", "license_scan", "language_id", "ngram_join", "line_dedup", "packing", "fingerprints", "quality_rules", "pii", "collocations", "passage_dedup", "vector_codes")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
