"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from gristmill.plans import account_queries, composed_queries, history_queries, module_queries, report_queries, review_queries, scan_queries, stream_queries

MODULES = (scan_queries, history_queries, review_queries, composed_queries, account_queries, module_queries, stream_queries, report_queries)
QUERIES: dict = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: sql for m in MODULES for n, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "scan_outcomes"
