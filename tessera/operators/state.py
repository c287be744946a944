"""State revisions, queues and ledgers as append-only tables.

There is no table format with updates here, so every change is a row, and reads take the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a todo, kinds of flags, resolutions.
TODO_STATUS = ["pending", "in_progress", "done", "blocked", "cancelled"]
FLAG_YOUNG_MINUTES = 30
MOST_ATTEMPTS = 3


def latest_state(revisions: DataFrame, scopes: DataFrame | None = None, session: str | None = None) -> DataFrame:
    """The last revision of each entity; deleted ones give none.

    If the last row's schema is of session scope (scopes: schema_id, scope) and a session is given, the
    last row of that session, or without a session, counts instead.
    """
    own, order = revisions.columns, F.struct("created_at", "rev_id")

    def last(rows: DataFrame) -> DataFrame:  # combines before it deals, however long a history is
        row = rows.groupBy("entity_id").agg(F.max_by(F.struct(*(c for c in own if c != "entity_id")), order).alias("__r"))
        row = row.select(*(F.col(c) if c == "entity_id" else F.col(f"__r.{c}").alias(c) for c in own))
        return row.where("payload IS NOT NULL")

    if scopes is None or session is None:
        return last(revisions)
    s = scopes.where("scope = 'session'").select(F.col("schema_id").alias("__last")).distinct()
    scoped = revisions.groupBy("entity_id").agg(F.max_by("schema_id", order).alias("__last")).join(s, "__last", "left_semi").select("entity_id")
    fits = F.col("session_id").isNull() | (F.col("session_id") == session)
    return last(revisions.join(scoped, "entity_id", "left_anti").unionByName(revisions.join(scoped, "entity_id", "left_semi").where(fits)))


def upsert_entities(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities after upserts in order of ts: name, kind and properties are overwritten, empty content and the default importance 3 keep the old, status becomes active."""
    cols = ["id", "name", "kind", "content", "importance", "properties", "session_id", "intent_id", "status", "ts"]
    both = current.select(*cols, F.lit(0).alias("o")).unionByName(changes.select(*cols, F.lit(1).alias("o")))
    key = F.struct("o", "ts")
    last = lambda c, when=None: F.max_by(c, key if when is None else F.when(when, key))
    fresh = F.col("o") == 1
    return both.groupBy("id").agg(
        last("name").alias("name"), last("kind").alias("kind"),
        last("content", F.coalesce(F.col("content"), F.lit("")) != "").alias("content"),
        F.coalesce(last("importance", F.coalesce(F.col("importance"), F.lit(3)) != 3), F.lit(3)).alias("importance"),
        last("properties").alias("properties"),
        F.min_by("session_id", F.when(F.col("session_id").isNotNull(), key)).alias("session_id"), F.min_by("intent_id", F.when(F.col("intent_id").isNotNull(), key)).alias("intent_id"),
        F.when(F.max(fresh), "active").otherwise(last("status")).alias("status"),
    )


def add_triples(triples: DataFrame, new: DataFrame, entities: DataFrame, skip: list[str]) -> DataFrame:
    """New facts to append: both ends exist, a statement unless the predicate is on the skip list, not a current fact already; the first of equal ones."""
    ids = entities.where("status = 'active'").select("id")
    ok = new.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")
    ok = ok.where(F.col("predicate").isin(skip) | (F.coalesce(F.trim("statement"), F.lit("")) != ""))
    ok = ok.join(triples.where("valid_to IS NULL"), ["subject", "predicate", "object"], "left_anti")
    w = Window.partitionBy("subject", "predicate", "object").orderBy("id")
    return ok.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*new.columns)


def invalidate(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """Facts with valid_to set where (subject, predicate, object, ended) names a current one."""
    e = closed.groupBy("subject", "predicate", "object").agg(F.max("ended").alias("__ended"))
    out = triples.join(e, ["subject", "predicate", "object"], "left")
    return out.withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("__ended")).otherwise(F.col("valid_to"))).select(*triples.columns)


def soft_delete(entities: DataFrame, triples: DataFrame, ids: DataFrame, ended: str) -> tuple[DataFrame, DataFrame]:
    """Entities with ``ids`` marked deleted, and facts with every current edge of theirs closed."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    e = entities.join(gone, entities["id"] == gone["__id"], "left").withColumn("status", F.when(F.col("__id").isNotNull(), "deleted").otherwise(F.col("status")))
    s, o = gone.withColumnRenamed("__id", "__s"), gone.withColumnRenamed("__id", "__o")
    t = triples.join(s, F.col("subject") == F.col("__s"), "left").join(o, F.col("object") == F.col("__o"), "left")
    hit = F.col("valid_to").isNull() & (F.col("__s").isNotNull() | F.col("__o").isNotNull())
    return e.select(*entities.columns), t.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to"))).select(*triples.columns)


def merge_entities(entities: DataFrame, triples: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, facts and new aliases after merges (source, target): ends are rewritten, sources marked; equal facts become one."""
    m = merges.groupBy("source").agg(F.min("target").alias("target"))
    e = entities.join(m, entities["id"] == m["source"], "left").withColumn("status", F.when(F.col("target").isNotNull(), "merged").otherwise(F.col("status")))
    e = e.select(*entities.columns, F.col("target").alias("merged_into"))
    t = triples
    for end in ("subject", "object"):
        x = m.select(F.col("source").alias("__s"), F.col("target").alias("__t"))
        t = t.join(x, F.col(end) == F.col("__s"), "left").withColumn(end, F.coalesce("__t", end)).select(*triples.columns)
    w = Window.partitionBy("subject", "predicate", "object", "valid_from", "valid_to").orderBy("id")
    t = t.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return e, t, m.select(F.col("source").alias("alias"), F.col("target").alias("canonical_id"))


def touch(entities: DataFrame, ids: DataFrame, ts: str) -> DataFrame:
    """Entities with last_touched set where used."""
    x = ids.select(F.col("id").alias("__id")).distinct()
    out = entities.join(x, entities["id"] == x["__id"], "left")
    return out.withColumn("last_touched", F.when(F.col("__id").isNotNull(), F.lit(ts)).otherwise(F.col("last_touched"))).select(*entities.columns)


def merge_properties(old: str | Column, new: str | Column) -> Column:
    """Two JSON objects, the second's values first."""
    kind = "map<string,string>"
    o, n = (F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, kind), F.create_map().cast(kind)) for c in (old, new))
    return F.to_json(F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n))


# ---- versions of payloads ----

TODO = "struct<id:string,text:string,status:string,blocker:string>"


def todos(texts: Column, prefix: str) -> Column:
    """Plain strings as pending todos with numbered ids."""
    return F.transform(texts, lambda x, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("id"), x.alias("text"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("blocker")))


def migrate_project(payload: Column) -> Column:
    """v1 {current_phase, active_branches, blockers, open_questions, recent_milestones} to v2: todos, and the last five milestones."""
    v1 = F.from_json(payload, "current_phase string, active_branches array<string>, blockers array<string>, open_questions array<string>, recent_milestones array<string>")
    none = F.array().cast("array<string>")
    blocked = F.transform(F.coalesce(v1["blockers"], none), lambda x, i: F.struct(F.concat(F.lit("b"), (i + 1).cast("string")).alias("id"), x.alias("text"), F.lit("blocked").alias("status"), x.alias("blocker")))
    m = F.coalesce(v1["recent_milestones"], none)
    last = F.when(F.size(m) > 5, F.slice(m, F.greatest(F.size(m) - 4, F.lit(1)), 5)).otherwise(m)
    named = F.transform(last, lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("date")))
    return F.to_json(F.struct(v1["current_phase"].alias("current_phase"), F.coalesce(v1["active_branches"], none).alias("active_branches"), F.concat(blocked, todos(F.coalesce(v1["open_questions"], none), "q")).alias("open_todos"), named.alias("recent_milestones")))


def migrate_agent(payload: Column) -> Column:
    v1 = F.from_json(payload, "current_focus string, active_intent_id string, pending_followups array<string>, recent_findings array<string>")
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(v1["current_focus"].alias("current_focus"), v1["active_intent_id"].alias("active_intent_id"), todos(F.coalesce(v1["pending_followups"], none), "f").alias("pending_followups"), F.coalesce(v1["recent_findings"], none).alias("recent_findings")))


def migrate_task(payload: Column) -> Column:
    v1 = F.from_json(payload, "status string, assignee string, due_date string, blockers array<string>")
    return F.to_json(F.struct(v1["status"].alias("status"), F.array().cast(f"array<{TODO}>").alias("subtodos"), v1["assignee"].alias("assignee"), v1["due_date"].alias("due_date"), F.nullif(F.array_join(v1["blockers"], "; "), F.lit("")).alias("blocker")))


def migrate_intent(payload: Column) -> Column:
    v1 = F.from_json(payload, "current_step string, remaining_steps array<string>, latest_observation string")
    none = F.array().cast("array<string>")
    now = F.when(F.coalesce(v1["current_step"], F.lit("")) != "", F.array(F.struct(F.lit("s0").alias("id"), v1["current_step"].alias("text"), F.lit("in_progress").alias("status"), F.lit(None).cast("string").alias("blocker"))))
    steps = F.concat(F.coalesce(now, F.array().cast(f"array<{TODO}>")), todos(F.coalesce(v1["remaining_steps"], none), "s"))
    return F.to_json(F.struct(steps.alias("todos"), F.when(F.coalesce(v1["current_step"], F.lit("")) != "", "s0").alias("active_todo_id"), v1["latest_observation"].alias("latest_observation")))


MIGRATIONS = {"project_state": migrate_project, "agent_state": migrate_agent, "task_state": migrate_task, "intent_state": migrate_intent}
CURRENT_VERSION = 2
DEFAULTS = {
    "project_state": '{"current_phase":"unknown","active_branches":[],"open_todos":[],"recent_milestones":[]}',
    "intent_state": '{"todos":[]}',
    "agent_state": '{"current_focus":"idle","pending_followups":[],"recent_findings":[]}',
    "task_state": '{"status":"pending","subtodos":[]}',
}


def migrate_latest(revisions: DataFrame, now: str) -> DataFrame:
    """New revisions for entities whose last one is behind: the payload rewritten, version and time set, the id from the old one."""
    last = latest_state(revisions).where(F.coalesce("schema_version", F.lit(1)) < CURRENT_VERSION)
    payload = F.col("payload")
    for schema, f in MIGRATIONS.items():
        payload = F.when(F.col("schema_id") == schema, f(F.col("payload"))).otherwise(payload)
    return last.withColumn("payload", payload).withColumn("schema_version", F.lit(CURRENT_VERSION)).withColumn("created_at", F.lit(now)).withColumn("rev_id", F.concat("rev_id", F.lit("_v2")))


def default_payload(schema: str | Column) -> Column:
    s = F.col(schema) if isinstance(schema, str) else schema
    out = F.lit("{}")
    for k, v in DEFAULTS.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def initial_revisions(bearers: DataFrame, revisions: DataFrame, now: str) -> DataFrame:
    """First revisions (rev_id, entity_id, schema_id, payload, created_at, schema_version) for bearers (entity_id, schema_id) that have none, with the schema's default payload.

    The id follows from the entity, so that a replay appends nothing new; of several schemas of an entity the least counts.
    """
    lacking = bearers.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("schema_id").alias("schema_id")).join(revisions.select("entity_id").distinct(), "entity_id", "left_anti")
    return lacking.select(
        F.concat(F.lit("init_"), "entity_id").alias("rev_id"), "entity_id", "schema_id", default_payload("schema_id").alias("payload"), F.lit(now).alias("created_at"), F.lit(CURRENT_VERSION).alias("schema_version")
    )


def pending_count(queue: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """One row: open flags that may still be attempted, and open ones that are frozen."""
    open_ = F.col("resolution").isNull()
    return queue.agg(F.count_if(open_ & (F.col("attempted_count") < most)).alias("pending"), F.count_if(open_ & (F.col("attempted_count") >= most)).alias("frozen"))


def due(runs: DataFrame, pending: DataFrame, now: str, every: str = "1 hour", least: int = 1) -> DataFrame:
    """(agent, pending, last_run) of those whose queue holds ``least`` rows or more and whose last run is ``every`` or longer ago, or never was.

    runs: agent, started_ts; pending: agent.
    """
    last = runs.groupBy("agent").agg(F.max("started_ts").alias("last_run"))
    n = pending.groupBy("agent").agg(F.count("*").alias("pending")).where(F.col("pending") >= least)
    ago = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {every}")
    return n.join(last, "agent", "left").where(F.col("last_run").isNull() | (F.col("last_run") <= ago)).select("agent", "pending", "last_run")


def valid_payloads(revisions: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Revisions with ``valid``: the payload parses as ``schema`` and has the required fields."""
    p = F.from_json("payload", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    ok = p.isNotNull() & p["_corrupt_record"].isNull()
    for r in required:
        ok = ok & p[r].isNotNull()
    return revisions.withColumn("valid", F.coalesce(ok, F.lit(False)))


# ---- queues ----


def memory_key(ids: str | Column) -> Column:
    return F.array_join(F.array_sort(F.col(ids) if isinstance(ids, str) else ids), "|")


def record_flags(pending: DataFrame, flags: DataFrame, created: DataFrame, now: str, young: int = FLAG_YOUNG_MINUTES) -> DataFrame:
    """The queue after new flags (kind, memory_ids, context_id, ts).

    Flags that name a memory (id, created_at) of the last ``young`` minutes are dropped; an unresolved
    flag of the same kind, memories and context gains an attempt instead of a second row.
    """
    bar = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(young))
    fresh = created.where(F.to_timestamp("created_at") > bar).select(F.col("id").alias("__id"))
    f = flags.withColumn("memory_key", memory_key("memory_ids"))
    hit = f.select("memory_key", F.explode("memory_ids").alias("__id")).distinct().join(fresh, "__id", "left_semi").select("memory_key").distinct()
    f = f.join(hit, "memory_key", "left_anti")
    both = pending.select("kind", "memory_key", "context_id", "attempted_count", F.col("last_attempt_ts").alias("ts"), F.lit(0).alias("new")).unionByName(
        f.select("kind", "memory_key", "context_id", F.lit(0).alias("attempted_count"), "ts", F.lit(1).alias("new"))
    )
    g = both.groupBy("kind", "memory_key", "context_id").agg(F.sum("attempted_count").alias("a"), F.sum("new").alias("n"), F.min("new").alias("only_new"), F.max("ts").alias("last_attempt_ts"))
    return g.select("kind", "memory_key", "context_id", (F.col("a") + F.col("n") - F.col("only_new")).cast("long").alias("attempted_count"), "last_attempt_ts")


def pending_flags(queue: DataFrame, limit: int, most: int = MOST_ATTEMPTS) -> DataFrame:
    return queue.where((F.col("attempted_count") < most) & F.col("resolution").isNull()).orderBy("attempted_count", F.desc("last_attempt_ts"), "memory_key").limit(limit)


def upsert_candidates(evidence: DataFrame, triples: DataFrame) -> DataFrame:
    """(from_entity, to_entity, score, shared_context_count) of evidence (a, b, w, ctx): pairs in order, once per context, none that an edge joins already."""
    e = evidence.select(F.least("a", "b").alias("from_entity"), F.greatest("a", "b").alias("to_entity"), "w", "ctx").where("from_entity <> to_entity")
    e = e.groupBy("from_entity", "to_entity", "ctx").agg(F.max("w").alias("w"))
    edges = triples.where("valid_to IS NULL OR valid_to = ''").select(F.least("subject", "object").alias("from_entity"), F.greatest("subject", "object").alias("to_entity"))
    e = e.join(edges.distinct(), ["from_entity", "to_entity"], "left_anti")
    return e.groupBy("from_entity", "to_entity").agg(F.sum("w").alias("score"), F.count("*").alias("shared_context_count"))


def pending_candidates(candidates: DataFrame, limit: int, threshold: float = 1.5) -> DataFrame:
    return candidates.where((F.col("score") >= threshold) & F.col("processed_ts").isNull()).orderBy(F.desc("score"), "from_entity", "to_entity").limit(limit)


def latest_resolution(ledger: DataFrame) -> DataFrame:
    w = Window.partitionBy("existing_id", "new_id", "conflict_type").orderBy(F.desc("created_at"), F.desc("conflict_id"))
    return ledger.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def check_resolutions(actions: DataFrame, least: int = 15, same: int = 3) -> DataFrame:
    """Actions with ``accepted``: the reason has 15 characters and isn't given three times or more."""
    n = F.count("*").over(Window.partitionBy(F.trim("reason")))
    known = F.col("action").isin("invalidate", "merge", "keep", "skip")
    return actions.withColumn("accepted", known & (F.length(F.trim("reason")) >= least) & (n < same))


def remap_ids(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """``col`` through (old, new); mappings whose target exists already as an old id are left out."""
    taken = mapping.select(F.col("old").alias("new"))
    m = mapping.join(taken, "new", "left_anti").select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return df.join(m, F.col(col) == F.col("__old"), "left").withColumn(col, F.coalesce("__new", col)).select(*df.columns)


def renumber(df: DataFrame, prefix: str, order: list, start: int = 0) -> DataFrame:
    """Ids prefix_n in order, after ``start``; numbered within ranges, so no task holds all rows."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id())
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))  # one row per range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.join(sizes.withColumn("__before", before), "__p")
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__k"))
    return parts.withColumn("new_id", F.concat(F.lit(prefix), F.lit("_"), (F.lit(start) + F.col("__before") + within).cast("string"))).drop("__p", "__k", "__n", "__before")


def promotion_candidates(runs: DataFrame, threshold: float, least: int = 3) -> DataFrame:
    """Intent types with ``least`` or more executions over a score."""
    return runs.groupBy("type").agg(F.count_if(F.col("score") > threshold).alias("good"), F.avg("score").alias("mean_score"), F.count("*").alias("runs")).where(F.col("good") >= least)


def replace_everywhere(df: DataFrame, old: str, new: str) -> DataFrame:
    """Every string column with ``old`` replaced."""
    return df.select(*(F.replace(c, F.lit(old), F.lit(new)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
