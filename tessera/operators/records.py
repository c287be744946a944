"""Smaller reads and writes of a memory service as tables: contexts, diaries, conflicts, profiles, templates, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold_ascii, normalize_entity_name, slugify
from tessera.operators.kg import is_current

#: Least and most queries, keywords and entities of a context.
ARITY = {"queries": (2, 5), "keywords": (2, 5), "entities": (1, 10)}


# ---- contexts ----


def _fold_list(c: Column) -> Column:
    """Every element in ASCII; elements keep their places."""
    joined = F.split(fold_ascii(F.array_join(c, "\x01")), "\x01")
    return F.when(F.size(c) > 0, joined).otherwise(c)


def validate_contexts(contexts: DataFrame, arity: dict[str, tuple[int, int]] = ARITY, reading: bool = False) -> DataFrame:
    """Contexts (queries, keywords, entities, more) with these lists cleaned, and ``problem``: the first that has too few entries, else null.

    Blank entries don't count; a list that is too long is cut; queries and keywords are folded to ASCII.  Who only reads needs
    no entities.  A null list is an empty one.
    """
    least = {k: 0 if reading and k == "entities" else lo for k, (lo, _) in arity.items()}
    clean = {k: F.filter(F.coalesce(k, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x, F.lit(" \t\n\r\f\x0b")) != "")) for k in arity}
    problem = F.lit(None).cast("string")
    for k in reversed(arity):
        problem = F.when(F.size(clean[k]) < least[k], k).otherwise(problem)
    made = {k: F.slice(clean[k], 1, hi) for k, (_, hi) in arity.items()}
    made = {k: c if k == "entities" else _fold_list(c) for k, c in made.items()}
    return contexts.select(*(c for c in contexts.columns if c not in arity), *(F.when(problem.isNull(), made[k]).alias(k) for k in arity), problem.alias("problem"))


def attach_context_rank(hierarchy: DataFrame, fused: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (query_id, id, more) with context_rank (from 0) and context_score of fused hits (query_id, id, rrf) on views of owners (id, owner_id).

    An owner's best view counts; ids without an owner are their own; ties by id.  What no hit reaches has nulls.
    """
    o = owners.select("id", "owner_id").distinct()
    best = fused.join(o, "id", "left").groupBy("query_id", F.coalesce("owner_id", "id").alias("id")).agg(F.max("rrf").alias("__s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("__s"), "id")
    best = best.select("query_id", "id", (F.row_number().over(w) - 1).alias("context_rank"), F.round("__s", 6).alias("context_score"))
    return hierarchy.join(best, ["query_id", "id"], "left")


# ---- diaries ----


def diary_records(entries: DataFrame) -> DataFrame:
    """Entries (agent, entry, slug, topic, at) as records; the id is the agent's and the slug's, or that of time and topic.

    Entries without an agent or a text are left out.
    """
    topic = F.coalesce("topic", F.lit("general"))
    slug = F.when(F.trim(F.coalesce("slug", F.lit(""))) != "", F.col("slug")).otherwise(F.concat(F.date_format("at", "yyyyMMdd-HHmmss"), F.lit("-"), topic))
    e = entries.where("trim(agent) <> '' AND trim(entry) <> ''")
    return e.select(
        F.concat(F.lit("diary_"), normalize_entity_name("agent"), F.lit("_"), slugify(slug)).alias("id"), F.col("entry").alias("text"), F.col("agent").alias("added_by"),
        topic.alias("topic"), F.lit("diary_entry").alias("type"), F.lit("diary").alias("content_type"), F.date_format("at", "yyyy-MM-dd").alias("date"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("filed_at"),
    )


def read_diary(records: DataFrame, agents: DataFrame, limit: int = 10) -> DataFrame:
    """(added_by, position, date, timestamp, topic, content, total): the last ``limit`` entries of each agent asked for, latest first, ties by id."""
    e = records.where("type = 'diary_entry'").join(agents.select(F.col("agent").alias("added_by")).distinct(), "added_by", "left_semi")
    total = e.groupBy("added_by").agg(F.count("*").alias("total"))
    w = Window.partitionBy("added_by").orderBy(F.desc("filed_at"), "id")
    last = e.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return last.join(total, "added_by").select("added_by", "position", "date", F.col("filed_at").alias("timestamp"), "topic", F.col("text").alias("content"), "total")


# ---- conflicts ----

PENDING = ["id", "conflict_type", "reason", "existing_id", "existing_preview", "new_id", "similarity"]


def pending_conflicts(conflicts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Open conflicts, as much of them as a caller needs, each with the last resolution (action, when, reason) that the same pair had.

    ledger: existing_id, new_id, conflict_type, conflict_id, created_at, action, reason.
    """
    key = ["existing_id", "new_id", "conflict_type"]
    past = ledger.groupBy(*key).agg(F.max_by(F.struct("action", F.col("created_at").alias("when"), "reason"), F.struct("created_at", "conflict_id")).alias("past_resolution"))
    return conflicts.where("resolved_at IS NULL").select(*PENDING).join(past, key, "left").select(*PENDING, "past_resolution")


def resolution_hints(pending: DataFrame, by: list[str]) -> DataFrame:
    """(by, hint): a line for each pending conflict that was decided before, in order of id; without such conflicts no row."""
    p = F.col("past_resolution")
    reason = F.trim(F.coalesce(p["reason"], F.lit("")))
    reason = F.when(F.length(reason) > 100, F.concat(F.substring(reason, 1, 97), F.lit("..."))).otherwise(reason)
    line = F.concat(F.lit("  • "), F.coalesce("id", F.lit("?")), F.lit(": last time you chose '"), F.coalesce(p["action"], F.lit("?")), F.lit("' ("), F.substring(F.coalesce(p["when"].cast("string"), F.lit("")), 1, 10), F.lit(") — "), reason)
    told = pending.where(p.isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l"))
    return told.select(*by, F.concat(F.lit("Past resolutions on matching conflicts (use as guidance, still your call):\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("hint"))


# ---- operations ----


def operation_profiles(tools: DataFrame, entities: DataFrame, triples: DataFrame, root: str = "operation") -> DataFrame:
    """(tool, id, slots) of the class of operations that names a tool in its profile; of several the most important, then the last touched, then the least id.

    entities: id, kind, status, importance, last_touched, properties (JSON with rules_profile.tool and .slots).  Tools without a class are left out.
    """
    ops = triples.where((F.col("predicate") == "is_a") & is_current() & (F.col("object") == root)).select(F.col("subject").alias("id")).distinct()
    c = entities.where("status = 'active' AND kind = 'class'").join(ops, "id", "left_semi")
    named = F.trim(F.get_json_object("properties", "$.rules_profile.tool"))
    c = c.select(named.alias("tool"), "id", F.coalesce(F.get_json_object("properties", "$.rules_profile.slots"), F.lit("{}")).alias("slots"), "importance", "last_touched").where("tool <> ''")
    asked = tools.select(F.trim("tool").alias("tool")).distinct()
    w = Window.partitionBy("tool").orderBy(F.desc("importance"), F.desc("last_touched"), "id")
    return c.join(asked, "tool", "left_semi").withColumn("__r", F.row_number().over(w)).where("__r = 1").select("tool", "id", "slots")


def operation_templates(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (id, title, content, what, why, scope, op_ids) of clusters (op_ids, title, when_to_use, recipe, failure_modes), and their edges (subject, predicate, object) to each operation.

    The id follows from the operations, so that a cluster told again is the same record.  Clusters of fewer than two operations, or
    without a title, use or recipe, are left out.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    ids = F.filter(F.coalesce("op_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    modes = F.filter(F.transform(F.coalesce("failure_modes", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    c = clusters.select(ids.alias("op_ids"), text("title").alias("title"), text("when_to_use").alias("use"), text("recipe").alias("recipe"), modes.alias("modes"))
    c = c.where("size(op_ids) >= 2 AND title <> '' AND use <> '' AND recipe <> ''")
    n = F.size("op_ids").cast("string")
    failures = F.when(F.size("modes") > 0, F.concat(F.lit("\n\n## Failure modes\n- "), F.array_join("modes", "\n- "))).otherwise("")
    body = F.concat(
        F.lit("# "), F.substring("title", 1, 80), F.lit("\n\n## When to use\n"), "use", F.lit("\n\n## Recipe\n"), "recipe", failures, F.lit("\n\nDerived from "), n, F.lit(" operation(s): "), F.array_join("op_ids", ", ")
    )
    why = F.substring("use", 1, 240)
    why = F.when(F.length(why) < 15, F.substring(F.concat(why, F.lit(" (operation template covering "), n, F.lit(" clustered operations)")), 1, 240)).otherwise(why)
    made = c.select(
        F.concat(F.lit("record_op_template_"), F.substring(F.sha1(F.array_join(F.array_sort("op_ids"), "|").cast("binary")), 1, 12)).alias("id"), "title", body.alias("content"),
        F.when(F.length("title") > 8, F.substring("title", 1, 118)).otherwise(F.concat(F.lit("operation template: "), "title")).alias("what"), why.alias("why"),
        F.concat(F.lit("derived from "), n, F.lit(" clustered operations")).alias("scope"), "op_ids",
    )
    edges = made.select(F.col("id").alias("subject"), F.lit("templatizes").alias("predicate"), F.explode(F.array_distinct("op_ids")).alias("object")).distinct()
    return made.dropDuplicates(["id"]), edges


# ---- transcripts ----

_MONTHS = "January February March April May June July August September October November December".split()
_STAMP = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
_COMMAND = r"^(\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)"


def session_metadata(transcripts: DataFrame, people: DataFrame, usernames: DataFrame, text: str = "text") -> DataFrame:
    """``transcripts`` with stamp and date (of the first time line among 50), people (known names, or mapped user names, within 100 lines) and subject.

    people: name; usernames: username, name.  The subject is the first prompt of over five characters that is no shell command, as a file name.
    """
    lines = F.split(text, "\n")
    first = lambda n: F.array_join(F.slice(lines, 1, n), "\n")
    part = lambda k: F.regexp_extract(first(50), _STAMP, k)
    months = F.create_map(*(F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m, f"{i:02d}")))
    date = F.when(part(4) != "", F.concat_ws("-", part(4), F.coalesce(F.try_element_at(months, part(2)), F.lit("00")), F.lpad(part(3), 2, "0")))
    prompts = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("> "))), lambda x: F.trim(F.substr(x, F.lit(3)))), lambda x: (F.length(x) > 5) & ~x.rlike(_COMMAND))
    subject = F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.get(prompts, F.lit(0)), r"[^\p{L}\p{N}_\s-]", "")), r"\s+", "-"), 1, 60)
    rows = transcripts.withColumn("__k", F.xxhash64(*transcripts.columns))
    head = rows.select("__k", first(100).alias("__t")).distinct()
    words = head.select("__k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("__t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("__w"))
    named = words.join(people.select(F.lower("name").alias("__w"), "name").distinct(), "__w").select("__k", "name")
    user = head.select("__k", F.regexp_extract("__t", r"/Users/(\w+)/", 1).alias("username")).join(usernames, "username").select("__k", "name")
    found = named.unionByName(user).groupBy("__k").agg(F.array_sort(F.collect_set("name")).alias("people"))
    out = rows.join(found, "__k", "left")
    return out.select(
        *transcripts.columns, F.when(date.isNotNull(), F.concat(date, F.lit("_"), F.regexp_replace(part(1), r"[:\s]", ""))).alias("stamp"), date.alias("date"),
        F.coalesce("people", F.array().cast("array<string>")).alias("people"), F.coalesce(subject, F.lit("session")).alias("subject"),
    )
