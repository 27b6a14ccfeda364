"""All queries of the core, by name."""

from __future__ import annotations

from larkspur.plans import crawl_queries, graph_queries, incremental_queries, ingest_queries, log_queries, search_queries, stream_queries, text_queries

MODULES = [incremental_queries, text_queries, search_queries, graph_queries, log_queries, crawl_queries, ingest_queries, stream_queries]
FLAGSHIP = "bm25f_search"

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
