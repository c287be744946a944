"""What callers are shown: pages, status, rooms of texts, contexts behind hits and candidates, templates, and views that are missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import top_k

#: Keywords of rooms, in order.
ROOM_KEYWORDS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "personal": ["family", "friend", "birthday", "vacation", "hobby", "health", "feeling", "love", "home", "weekend"],
    "knowledge": ["learn", "study", "degree", "school", "university", "course", "research", "paper", "book", "reading"],
}
#: Fixed value: characters that decide a room.
ROOM_CHARS = 3000


def page(df: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The next ``size`` rows by ``key`` after a value, the first ones without one; the last row's key leads to the page that follows.

    Only the rows after the key are read, so that later pages cost no more than the first.
    """
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.where(F.col(key).isNotNull()).orderBy(key).limit(size)


def author_status(candidates: DataFrame) -> DataFrame:
    """(verdict, n, max_score): candidates that wait as ``pending``, processed ones by verdict, ``(null)`` without one."""
    verdict = F.when(F.col("processed_ts").isNull(), "pending").otherwise(F.coalesce("verdict", F.lit("(null)")))
    return candidates.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))


def room_of(text: str | Column, rooms: dict[str, list[str]] = ROOM_KEYWORDS) -> Column:
    """The room most of whose keywords the text's begin holds; the earlier room wins ties; `general` without any."""
    low = F.lower(F.substring(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 1, ROOM_CHARS))
    score = {r: sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) for r, words in rooms.items()}
    best = F.greatest(*score.values()) if len(score) > 1 else next(iter(score.values()))
    out = F.lit("general")
    for r in reversed(score):
        out = F.when((score[r] == best) & (best > 0), r).otherwise(out)
    return out


def shared_contexts(candidates: DataFrame, sources: DataFrame, contexts: DataFrame, recent: int = 5, queries: int = 2, keywords: int = 5) -> DataFrame:
    """(from_entity, to_entity, shared): what the latest contexts that two ends share asked, a line each; a note where nothing is known.

    sources: from_entity, to_entity, ctx_id, contributed_ts; contexts: ctx_id, queries, keywords.  The latest are chosen before unknown contexts are left out.
    """
    pair = ["from_entity", "to_entity"]
    last = top_k(sources.join(candidates.select(*pair).distinct(), pair, "left_semi"), pair, [F.desc("contributed_ts"), "ctx_id"], recent)
    listed = lambda c, n: F.concat(F.lit("["), F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), ", "), F.lit("]"))
    line = F.concat(F.lit("- queries="), listed("queries", queries), F.lit(" keywords="), listed("keywords", keywords))
    told = last.join(contexts, "ctx_id").groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    told = told.select(*pair, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("shared"))
    return candidates.select(*pair).distinct().join(told, pair, "left").withColumn("shared", F.coalesce("shared", F.lit("(no shared context metadata available)")))


def similar_contexts(hits: DataFrame, scores: DataFrame, neighbours: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, id, more) with the contexts that spoke for them, and those contexts (query_id, context_id, queries, keywords, link_score).

    scores: feedback.neighbourhood_scores (query_id, id, contexts); neighbours: query_id, context_id, weight.  Contexts that aren't known are named but not told of.
    """
    by = scores.where(F.size("contexts") > 0).select("query_id", "id", F.col("contexts").alias("similar_context_ids"))
    marked = hits.join(by, ["query_id", "id"], "left")
    named = marked.select("query_id", F.explode("similar_context_ids").alias("context_id")).distinct()
    weight = neighbours.groupBy("query_id", "context_id").agg(F.round(F.max("weight"), 4).alias("link_score"))
    return marked, named.join(contexts.select("context_id", "queries", "keywords"), "context_id").join(weight, ["query_id", "context_id"], "left").select("query_id", "context_id", "queries", "keywords", "link_score")


def hydrated_templates(hoisted: DataFrame, records: DataFrame) -> DataFrame:
    """Templates (template_id, op_id) with title, summary and full_content of their records (id, content, properties); blanks where the record is missing."""
    r = records.select(F.col("id").alias("template_id"), F.coalesce("content", F.lit("")).alias("__c"), "properties").dropDuplicates(["template_id"])
    j = hoisted.join(r, "template_id", "left")
    content, prop = F.coalesce("__c", F.lit("")), lambda k: F.get_json_object("properties", f"$.{k}")
    title = F.coalesce(F.nullif(prop("title"), F.lit("")), F.substring(content, 1, 80))
    return j.select("template_id", title.alias("title"), F.substring(content, 1, 280).alias("summary"), F.coalesce(prop("full_content"), F.lit("")).alias("full_content"), F.array("op_id").alias("op_ids"))


def missing_vectors(entities: DataFrame, vectors: DataFrame, embed: Callable[[Column | str], Column]) -> DataFrame:
    """(id, embedding) of entities (id, text) that have no vector (id) yet and aren't blank."""
    have = vectors.select("id").distinct()
    lacking = entities.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(have, "id", "left_anti")
    return lacking.select("id", embed("text").alias("embedding"))
