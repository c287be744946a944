"""Rankers of the retrieval benchmarks: distances (smaller is nearer) scaled by overlaps, dates, phrases, names and rooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as X
from tessera.functions import text as T

#: Weights of the rankers.
OVERLAP_V1, OVERLAP_PREDICATE, QUOTED, NAMES_V4, NAMES_ROOMS, TEMPORAL = 0.30, 0.50, 0.60, 0.40, 0.20, 0.40
ROOM, HALL_FIRST, HALL_SECOND, HALL_VALID = 0.8, 0.75, 0.90, 0.85


def hybrid_v1(distance: str, overlap: str | Column, weight: float = OVERLAP_V1) -> Column:
    return F.col(distance) * (1 - weight * (F.col(overlap) if isinstance(overlap, str) else overlap))


def hybrid_v2(distance: str, overlap: Column, boost: Column) -> Column:
    """With a boost of up to 0.40 near the date that the question names."""
    return hybrid_v1(distance, overlap) * (1 - boost)


def hybrid_v4(distance: str, overlap: Column, boost: Column, quoted: Column, names: Column) -> Column:
    return hybrid_v2(distance, overlap, boost) * (1 - QUOTED * quoted) * (1 - NAMES_V4 * names)


def rooms_score(distance: str, overlap: Column, quoted: Column, names: Column) -> Column:
    return F.col(distance) * (1 - OVERLAP_PREDICATE * overlap) * (1 - QUOTED * quoted) * (1 - NAMES_ROOMS * names)


def hall_score(distance: str, hall: Column, first: Column, second: Column, validated: Column, boost: Column) -> Column:
    scale = F.when(hall == first, HALL_FIRST).when(hall == second, HALL_SECOND).otherwise(1.0)
    return F.col(distance) * scale * F.when(validated, HALL_VALID).otherwise(1.0) * (1 - boost)


def room_score(distance: str, room: Column, wanted: Column) -> Column:
    return F.col(distance) * F.when(room == wanted, ROOM).otherwise(1.0)


def is_assistant_reference(question: str | Column, triggers: list[str] = X.ASSISTANT_REFERENCES) -> Column:
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    return q.rlike("|".join(t.replace(".", r"\.") for t in triggers))


def question_features(q: DataFrame) -> DataFrame:
    """q (query_id, question) with keywords, quoted phrases, names and the time that it names."""
    r = T.relative_days("question")
    return q.select(
        "query_id", "question", T.query_keywords("question").alias("keywords"), T.quoted_phrases("question").alias("quoted"), T.person_names("question").alias("names"), r.alias("when"),
        is_assistant_reference("question").alias("about_assistant"),
    )


def rerank(hits: DataFrame, features: DataFrame) -> DataFrame:
    """hits (query_id, id, distance, text, age) ranked by the fourth hybrid."""
    h = hits.join(features, "query_id")
    boost = T.temporal_boost("age", F.col("when.days"), F.col("when.tolerance"))
    names = T.keyword_overlap(F.transform("names", lambda x: F.lower(x)), "text")
    score = hybrid_v4("distance", T.keyword_overlap("keywords", "text"), boost, T.phrase_boost("quoted", "text"), names)
    h = h.withColumn("score", F.round(score, 9))
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).select("query_id", "id", "score", "rank")


def top_rooms(rooms: DataFrame, features: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, room): the rooms (room, summary) whose summaries share most keywords with the question."""
    s = features.crossJoin(rooms).withColumn("o", T.keyword_overlap("keywords", "summary"))
    w = Window.partitionBy("query_id").orderBy(F.desc("o"), "room")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "room", F.round("o", 6).alias("overlap"))


def evidence_found(results: DataFrame) -> DataFrame:
    """(query_id, found): either of retrieved and evidence text contains the other, for any pair of a query."""
    a, b = F.lower("retrieved"), F.lower("evidence")
    return results.groupBy("query_id").agg(F.max(F.contains(a, b) | F.contains(b, a)).alias("found"))


def target_hit(results: DataFrame) -> DataFrame:
    """(query_id, hit): any target step is among the retrieved session or global indices."""
    return results.select("query_id", (F.arrays_overlap("targets", "sids") | F.arrays_overlap("targets", "globals")).alias("hit"))


def turn_text(time: Column, user: Column, assistant: Column) -> Column:
    blank = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws(" ", F.when(F.coalesce(time, F.lit("")) != "", F.concat(F.lit("["), time, F.lit("]"))), blank("[User] ", user), blank("[Assistant] ", assistant))


def split_dev(ids: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """The first ``n`` ids of a seeded shuffle are dev, the rest held out."""
    dev = ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select(F.col("id").alias("__id"))
    out = ids.join(dev, ids["id"] == dev["__id"], "left")
    return out.select("id", F.when(F.col("__id").isNotNull(), "dev").otherwise("held_out").alias("part"))


def corpus(messages: DataFrame, by_turn: bool = False) -> DataFrame:
    """One document for each conversation, or each turn, from (conv_id, turn, role, text)."""
    if by_turn:
        return messages.select(F.concat("conv_id", F.lit("_turn_"), "turn").alias("id"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return messages.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_join(parts, "\n").alias("text"))
