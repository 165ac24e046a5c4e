"""All queries of the library, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from quire.plans import extension, index, ingest, pdf, retrieval, structure, text, tree, usage

_MODULES = (usage, text, retrieval, tree, structure, index, ingest, pdf, extension)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
