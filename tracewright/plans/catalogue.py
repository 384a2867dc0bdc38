"""Registry of the core queries: name -> callable(spark, sf_dir), and the SQL that checks it."""

from __future__ import annotations

from . import corpus_queries, ledger_queries, probe_queries, report_queries, score_queries, trace_queries

_MODULES = (trace_queries, score_queries, corpus_queries, report_queries, probe_queries, ledger_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
