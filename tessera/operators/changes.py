"""Writes to queues, run logs and entities as tables of actions, applied all at once.

Actions carry an order (ts, seq).  What a row-by-row store would end with follows from aggregates of a key's actions, so
that the actions of one key are combined before they are dealt, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a flag may be resolved, and what a run counts.
RESOLUTIONS = ("merged", "invalidated", "linked", "edge_proposed", "summary_rewritten", "pruned", "deferred", "no_action", "templatized", "state_initialized")
COUNTERS = ("merges", "invalidations", "links_created", "edges_proposed", "summary_rewrites", "prunes", "deferrals", "no_action")


def known_resolution(resolution: str | Column = "resolution") -> Column:
    return F.coalesce(F.col(resolution) if isinstance(resolution, str) else resolution, F.lit("")).isin(*RESOLUTIONS)


def apply_flag_actions(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """The queue (flag_id, attempted_count, last_attempt_ts, resolved_ts, resolution, resolution_note, more) after actions.

    Actions: flag_id, seq, ts, action (``resolve`` or ``bump``), resolution, note.  The first resolution of an open flag
    closes it; what comes after it does nothing, nor do actions on closed flags.  Both kinds count as an attempt.
    A resolution that isn't known is no action.
    """
    a = actions.where("action = 'bump'").unionByName(actions.where((F.col("action") == "resolve") & known_resolution()))
    a = a.join(queue.where("resolved_ts IS NULL").select("flag_id").distinct(), "flag_id", "left_semi")
    at = F.struct("ts", "seq")
    first = a.where("action = 'resolve'").groupBy("flag_id").agg(F.min(F.struct("ts", "seq", "resolution", F.coalesce("note", F.lit("")).alias("note"))).alias("__end"))
    a = a.join(first, "flag_id", "left").where(F.col("__end").isNull() | (at <= F.struct("__end.ts", "__end.seq")))
    done = a.groupBy("flag_id").agg(F.count("*").alias("__n"), F.max("ts").alias("__last"), F.any_value("__end").alias("__end"))
    out = queue.join(done, "flag_id", "left")
    open_ = F.col("resolved_ts").isNull()
    new = {
        "attempted_count": F.when(open_, F.col("attempted_count") + F.coalesce("__n", F.lit(0))).otherwise(F.col("attempted_count")),
        "last_attempt_ts": F.when(open_, F.coalesce("__last", "last_attempt_ts")).otherwise(F.col("last_attempt_ts")),
        "resolved_ts": F.coalesce("resolved_ts", "__end.ts"),
        "resolution": F.when(open_, F.col("__end.resolution")).otherwise(F.col("resolution")),
        "resolution_note": F.when(open_, F.col("__end.note")).otherwise(F.col("resolution_note")),
    }
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in queue.columns))


def close_runs(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Runs (run_id, started_ts, model) with what closed them: completed_ts, flags_processed, flag_ids, the counters, exit_code, errors.

    Closings: run_id, seq, ts, flag_ids, counters (a map; what it lacks is 0), exit_code, errors.  The last closing of a run
    counts; runs without one are open, with nulls; closings of unknown runs are left out.
    """
    body, order = F.struct("ts", "seq", "flag_ids", "counters", "exit_code", "errors"), F.struct("ts", "seq")
    # numbers are counted without sorting; only the narrow last of each time are sorted, and closings stream past those unsorted
    latest = closed.groupBy("run_id", "ts").agg(F.max("seq").alias("seq"))
    latest = latest.groupBy("run_id").agg(F.max(order).alias("l")).select(F.col("run_id").alias("__run"), F.col("l.ts").alias("__ts"), F.col("l.seq").alias("__seq"))
    met = (F.col("run_id") == F.col("__run")) & F.col("ts").eqNullSafe(F.col("__ts")) & F.col("seq").eqNullSafe(F.col("__seq"))
    last = closed.join(latest.hint("shuffle_hash"), met, "left_semi").groupBy("run_id").agg(F.max_by(body, order).alias("c"))
    out = opened.join(last, "run_id", "left")
    ids = F.coalesce("c.flag_ids", F.array().cast(dict(closed.dtypes)["flag_ids"]))
    done = F.col("c").isNotNull()
    counters = [F.when(done, F.coalesce(F.try_element_at("c.counters", F.lit(k)), F.lit(0)).cast("int")).alias(k) for k in COUNTERS]
    return out.select(
        *opened.columns, F.col("c.ts").alias("completed_ts"), F.when(done, F.size(ids)).alias("flags_processed"), F.when(done, ids).alias("flag_ids"), *counters,
        F.col("c.exit_code").alias("exit_code"), F.when(done, F.coalesce("c.errors", F.lit(""))).alias("errors"),
    )


def update_contents(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """Entities (id, content, importance, last_touched, more) after updates (id, seq, ts, content, importance): the last content, and the last importance that isn't null."""
    order = F.struct("ts", "seq")
    last = updates.groupBy("id").agg(
        F.max_by(F.struct("ts", "content"), order).alias("__u"), F.max_by("importance", F.when(F.col("importance").isNotNull(), order)).alias("__i")
    )
    out = entities.join(last, "id", "left")
    hit = F.col("__u").isNotNull()
    new = {
        "content": F.when(hit, F.col("__u.content")).otherwise(F.col("content")),
        "importance": F.coalesce("__i", "importance"),
        "last_touched": F.when(hit, F.col("__u.ts").cast(dict(entities.dtypes)["last_touched"])).otherwise(F.col("last_touched")),
    }
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in entities.columns))


def triple_feedback(feedback: DataFrame, contexts: DataFrame) -> DataFrame:
    """Current feedback on facts (context_id, triple_id, kind, relevance, confidence, rater_kind) of the contexts asked for."""
    now = feedback.where("valid_to IS NULL").join(contexts.select("context_id").distinct(), "context_id", "left_semi")
    return now.select("context_id", "triple_id", "kind", "relevance", "confidence", "rater_kind")
