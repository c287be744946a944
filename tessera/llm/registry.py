"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.config_packing import op8_config_packing
from tessera.llm.decontaminate import op4_decontaminate
from tessera.llm.filter_audit import op12_filter_audit
from tessera.llm.jaccard_join import op10_jaccard_join
from tessera.llm.language_id import op7_language_id
from tessera.llm.license_scan import op9_license_scan
from tessera.llm.line_dedup import op5_line_dedup
from tessera.llm.media_columns import op2_media_columns
from tessera.llm.oracles import ORACLE_SQL
from tessera.llm.packed_ids import op6_packed_ids
from tessera.llm.sharding import op1_shard_lookup
from tessera.llm.subspace_join import op11_subspace_join
from tessera.llm.token_alignment import op13_token_alignment
from tessera.llm.token_counts import op3_token_counts

_ALL = (
    op1_shard_lookup, op2_media_columns, op3_token_counts, op4_decontaminate, op5_line_dedup,
    op6_packed_ids, op7_language_id, op8_config_packing, op9_license_scan, op10_jaccard_join,
    op11_subspace_join, op12_filter_audit, op13_token_alignment,
)

__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES = {f.__name__: f for f in _ALL}
