"""All queries by name, with SQL of the same meaning."""

from __future__ import annotations

from tessera.plans import change_queries, kg_queries, memory_queries, queue_queries, rank_queries, record_queries, registry_queries, rendering_queries, search_queries, service_queries, text_queries, upkeep_queries

FLAGSHIP = "kg_query_as_of"
_PARTS = (kg_queries, rank_queries, search_queries, text_queries, service_queries, queue_queries, memory_queries, change_queries, registry_queries, record_queries, upkeep_queries, rendering_queries)
QUERIES: dict = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLE_SQL.items()}
