"""All queries of the core and their SQL, collected from the modules of this folder."""

from __future__ import annotations

from . import evidence_queries, legal_queries, registry_queries, retrieval_queries, text_queries

MODULES = (retrieval_queries, text_queries, registry_queries, evidence_queries, legal_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
