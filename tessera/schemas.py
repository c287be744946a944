"""Schemas of the engine's tables, as DDL strings for Spark."""

from __future__ import annotations

ENTITIES = (
    "id string, name string, kind string, type string, content string, importance int, last_touched string, status string, "
    "merged_into string, session_id string, intent_id string, creation_context_id string, created_at string, properties string"
)
TRIPLES = (
    "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, "
    "source_file string, extracted_at string, creation_context_id string, statement string, properties string"
)
ENTITY_ALIASES = "alias string, canonical_id string, merged_at string"
ENTITY_KEYWORDS = "entity_id string, keyword string, source string, added_at string"
KEYWORD_IDF = "keyword string, freq long, idf double, last_updated_ts string"
TRIPLE_CONTEXT_FEEDBACK = (
    "context_id string, triple_id string, kind string, relevance int, reason string, rater_kind string, rater_id string, "
    "confidence double, valid_from string, valid_to string, ts string"
)
SCORING_WEIGHT_FEEDBACK = "component string, component_value double, was_useful boolean, created_at string"
STATE_REVISIONS = (
    "rev_id string, entity_id string, schema_id string, payload string, created_at string, op_context_id string, agent string, "
    "schema_version int, session_id string"
)
MEMORY_FLAGS = (
    "kind string, memory_ids array<string>, memory_key string, detail string, context_id string, attempted_count int, "
    "last_attempt_ts string, resolved_ts string, resolution string, resolution_note string"
)
LINK_CANDIDATES = "from_entity string, to_entity string, score double, shared_context_count long, last_context_id string, processed_ts string"
CONFLICT_RESOLUTIONS = (
    "conflict_id string, conflict_type string, action string, reason string, existing_id string, new_id string, agent string, "
    "created_at string"
)
VIEWS = "owner_id string, view_index int, is_summary_view boolean, view_kind string, text string, embedding array<float>"
RECORDS = (
    "id string, text string, source_file string, chunk_index int, added_by string, content_type string, filed_at string, "
    "importance int, summary string, session_id string, intent_type string, kind string, entity_id string, embedding array<float>"
)
CANDIDATES = "query_id string, list_name string, channel string, weight double, id string, score double, text string"

#: Predicates whose statements are never embedded and may be missing.
SKIP_PREDICATES = [
    "is_a", "described_by", "evidenced_by", "executed_by", "targeted", "session_note_for", "derived_from", "mentioned_in",
    "created_under", "similar_to", "surfaced", "rated_useful", "rated_irrelevant", "templatizes", "executed_op",
    "performed_well", "performed_poorly", "superseded_by", "state_changed_by", "anchored_by",
]
#: Bookkeeping predicates that reads hide.
HIDDEN_PREDICATES = ["rated_useful", "rated_irrelevant", "surfaced"]
