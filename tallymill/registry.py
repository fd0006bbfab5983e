"""All queries of the library by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tallymill.plans import ingest, listing, reports, retrieval, service, usage

_MODULES = (usage, listing, retrieval, service, ingest, reports)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
