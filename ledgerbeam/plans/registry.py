"""All queries by name, and their SQL."""

from __future__ import annotations

from ledgerbeam.plans import audit_queries, debt_queries, ledger_queries, report_queries, review_queries, scale_queries, source_queries, workpaper

_MODULES = (ledger_queries, debt_queries, report_queries, review_queries, audit_queries, source_queries, scale_queries, workpaper)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
