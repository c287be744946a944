"""Queries of queues and of folds over ordered rows, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.fixtures import view, with_views
from tessera.streaming import queues

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def cue_events(e):
    """Clicks as calls and views as cues of two tools, from rows of the table events."""
    tool = F.concat(F.lit("t"), F.col("event_id") % 2).alias("tool")
    calls = e.where("event_type = 'click'").select(F.col("user_id").alias("session"), tool, F.col("ts").alias("call_ts"), F.col("event_id").alias("call_id"))
    cues = e.where("event_type = 'view'").select(F.col("user_id").alias("session"), tool, F.col("ts").alias("cue_ts"), F.col("event_id").alias("cue_id"))
    return queues.cue_events(calls, cues)


# the rule, event by event: each session's live cues are a list that calls prune and pop
@query("""
WITH RECURSIVE ev AS (SELECT CAST(user_id AS STRING) AS session, event_id AS id, ts, event_type = 'click' AS is_call, concat('t', event_id % 2) AS tool,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'click', event_id) AS n FROM events WHERE event_type IN ('click', 'view')),
r AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, tool VARCHAR, ts TIMESTAMP)[]) AS live, false AS is_call, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS STRUCT(id BIGINT, tool VARCHAR, ts TIMESTAMP)) AS cue, CAST(0 AS INT) AS n_expired FROM ev
  UNION ALL SELECT session, n, CASE WHEN is_call THEN list_filter(kept, lambda x: cue IS NULL OR x.id <> cue.id) ELSE list_append(live, {'id': id, 'tool': tool, 'ts': CAST(ts AS TIMESTAMP)}) END, is_call, CASE WHEN is_call THEN id END, CASE WHEN is_call THEN cue END, CASE WHEN is_call THEN CAST(len(live) - len(kept) AS INT) ELSE 0 END
  FROM (SELECT *, list_filter(kept, lambda x: x.tool = tool)[1] AS cue FROM (SELECT e.session, e.n, r.live, e.is_call, e.id, e.tool, e.ts, list_filter(r.live, lambda x: e.ts <= x.ts + INTERVAL 3 HOUR) AS kept FROM r JOIN ev AS e ON e.session = r.session AND e.n = r.n + 1) AS a) AS b)
SELECT session, call_id, coalesce(cue.id, -1) AS cue_id, n_expired FROM r WHERE is_call""")
def stream_consume_cues(spark, sf_dir):
    """Every call with the cue it pops, or -1: of its tool, within three hours, no cue twice."""
    found = queues.consume_cues(cue_events(view(spark, sf_dir, "events")), 3 * 3600)
    return found.select("session", "call_id", F.coalesce("cue_id", F.lit(-1)).alias("cue_id"), "n_expired")


def message_events(c):
    """User turns as messages whose ids repeat, assistant turns as drains, from rows of the table conversations."""
    action = F.when(F.col("role") == "user", "append").when(F.col("role") == "assistant", "clear").otherwise("none")
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("pos"), action.alias("action"), F.concat(F.lit("m"), F.length("text") % 5).alias("id"), "text")


@query("""
WITH e AS (SELECT CAST(conv_id AS STRING) AS session, turn, role, text, concat('m', length(text) % 5) AS id, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS b,
  min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS left_pos FROM conversations WHERE role IN ('user', 'assistant')),
u AS (SELECT *, row_number() OVER (PARTITION BY session, b, id ORDER BY turn) AS k FROM e WHERE role = 'user'), a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS turn_idx FROM u WHERE k = 1)
SELECT session, id, text, turn_idx, turn AS appended_pos, left_pos FROM a WHERE left_pos IS NOT NULL""")
def stream_pending_messages(spark, sf_dir):
    """Messages as they leave the queue of a conversation; an id that waits already isn't added again."""
    return queues.drain_messages(message_events(view(spark, sf_dir, "conversations")))
