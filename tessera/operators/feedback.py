"""Ratings: superseding, neighbourhood aggregates, learned weights, evidence for links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relevance 1 to 5 as (useful, confidence).
RELEVANCE = {1: (False, 1.0), 2: (False, 0.5), 3: (True, 0.2), 4: (True, 0.8), 5: (True, 1.0)}


def _relevance(relevance: str | Column) -> Column:
    r = F.col(relevance) if isinstance(relevance, str) else relevance
    return F.when(r.between(1, 5), r.cast("int")).otherwise(3)


def is_useful(relevance: str | Column) -> Column:
    return _relevance(relevance) >= 3


def confidence(relevance: str | Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, (_, c) in RELEVANCE.items() for x in (k, c)))
    return F.element_at(table, _relevance(relevance))


def record_feedback(ratings: DataFrame) -> DataFrame:
    """Ratings (context_id, memory_id, relevance, ts) as edges with kind and confidence; bad values count as 3."""
    kind = F.when(is_useful("relevance"), "rated_useful").otherwise("rated_irrelevant")
    return ratings.select("context_id", "memory_id", _relevance("relevance").alias("relevance"), kind.alias("kind"), confidence("relevance").alias("confidence"), "ts")


def supersede(ratings: DataFrame, key: list[str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """History with validity: each rating of a key ends when the next begins; the last one is open."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    return ratings.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w))


def current_ratings(ratings: DataFrame, key: list[str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The last rating of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts), F.desc(tie))
    return ratings.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


#: Parts by id in which pairs of queries and ids are made.
DEALT = 32


def neighbourhood_scores(neighbours: DataFrame, ratings: DataFrame, surfaced_weight: float = 0.3) -> DataFrame:
    """(query_id, id, rated, recall, contexts) over neighbours (query_id, context_id, weight) and current ratings.

    ``rated``: weight times confidence of useful minus irrelevant ratings, within -1 and 1 (null if only
    surfaced).  ``recall``: the same, unclamped, plus a share for being surfaced.  ``contexts``: the
    neighbours, not the query's own context, that contributed.
    """
    # queries with the same neighbours share their sums, so that pairs of query and id are made last, and never aggregated
    near = neighbours.where("context_id IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("context_id", "weight"))).alias("__near"))
    kinds = near.groupBy("__near").agg(F.min(F.struct("query_id")).alias("__first"))
    hit = kinds.select("__first", F.inline("__near")).join(ratings, "context_id")
    signed = F.when(F.col("kind") == "rated_useful", F.col("weight") * F.col("confidence")).when(F.col("kind") == "rated_irrelevant", -F.col("weight") * F.col("confidence"))
    surfaced = F.when(F.col("kind") == "surfaced", F.col("weight") * surfaced_weight)
    sums = hit.groupBy("__first", F.col("memory_id").alias("id")).agg(
        F.sum(signed).alias("rated"), F.coalesce(F.sum(signed), F.lit(0.0)).alias("net"), F.coalesce(F.sum(surfaced), F.lit(0.0)).alias("seen"), F.collect_set("context_id").alias("contexts")
    )
    # dealt by id as well, as few kinds may have all queries
    asking = near.join(kinds, "__near").select("query_id", "__first", F.explode(F.array(*map(F.lit, range(DEALT)))).alias("__part"))
    out = sums.withColumn("__part", F.pmod(F.hash("id"), F.lit(DEALT))).join(asking, ["__first", "__part"])
    clamped = F.when(F.col("rated").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rated"))))
    other = F.array_sort(F.filter("contexts", lambda c: c != F.col("query_id")))
    return out.select("query_id", "id", clamped.alias("rated"), (F.col("net") + F.col("seen")).alias("recall"), other.alias("contexts"))


def context_channel(scores: DataFrame) -> DataFrame:
    """Candidates of the context channel: net-positive recall."""
    return scores.where("recall > 0").select("query_id", "id", F.col("recall").alias("score"))


def observe_components(rows: DataFrame, components: list[str]) -> DataFrame:
    """Wide features and was_useful as observations (component, component_value, was_useful)."""
    return rows.unpivot(["was_useful"], components, "component", "component_value").select("component", "component_value", "was_useful")


def learned_weights(observations: DataFrame, base: DataFrame, least: int = 10, gain: float = 0.3) -> DataFrame:
    """(component, weight): base weights moved by what useful and irrelevant rows had, renormalised to sum 1.

    The move is the difference of means (0.5 where a class is missing), within -1 and 1, times ``gain``.
    With fewer than ``least`` observations the base weights stay.
    """
    means = observations.groupBy("component").agg(F.avg(F.when(F.col("was_useful"), F.col("component_value"))).alias("useful"), F.avg(F.when(~F.col("was_useful"), F.col("component_value"))).alias("irrelevant"))
    n = observations.agg(F.count("*").alias("n"))
    out = base.join(means, "component", "left").crossJoin(F.broadcast(n))  # n is one row
    moved = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("useful", F.lit(0.5)) - F.coalesce("irrelevant", F.lit(0.5))))
    out = out.withColumn("moved", F.col("base") * (1 + gain * moved))
    total = F.sum("moved").over(Window.partitionBy("n"))  # a handful of components
    return out.select("component", F.when(F.col("n") < least, F.col("base")).otherwise(F.col("moved") / total).alias("weight"))


def adamic_adar(members: DataFrame, relevance: DataFrame, least: float = 4.0) -> DataFrame:
    """(a, b, score, contexts): evidence that entities belong together.

    Every unordered pair of entities in a context (context_id, entity) whose mean relevance is at least
    ``least`` gains 1 / ln(size), once per context.  Contexts hold a few entities each (their size is
    part of the data model), so pairs are formed within a context only.
    """
    good = relevance.groupBy("context_id").agg(F.avg("relevance").alias("m")).where(F.col("m") >= least).select("context_id")
    m = members.select("context_id", "entity").distinct().join(good, "context_id", "left_semi")
    size = m.groupBy("context_id").agg(F.count("*").alias("n")).where("n >= 2")
    m = m.join(size, "context_id")
    pairs = m.alias("x").join(m.alias("y"), "context_id").where("x.entity < y.entity")
    return pairs.groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b")).agg(F.sum(1.0 / F.log("x.n")).alias("score"), F.count("*").alias("contexts"))


def rocchio_gate(ratings: DataFrame, least_n: int = 2, least_mean: float = 4.0) -> DataFrame:
    """Per context which of queries, keywords and entities to enrich, from (context_id, channels, relevance)."""
    each = ratings.select("context_id", F.explode(F.split("channels", ",")).alias("channel"), "relevance")
    bucket = F.when(F.col("channel") == "cosine", "queries").when(F.col("channel") == "keyword", "keywords").when(F.col("channel") == "graph", "entities")
    each = each.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    out = each.groupBy("context_id", "bucket").agg(F.count("*").alias("n"), F.avg("relevance").alias("mean_relevance"))
    return out.withColumn("enrich", (F.col("n") >= least_n) & (F.col("mean_relevance") >= least_mean))


def missing_coverage(required: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """Required pairs that nothing covers."""
    return required.select(*key).distinct().join(covered.select(*key).distinct(), key, "left_anti")


def operation_lanes(neighbours: DataFrame, operations: DataFrame, superseded: DataFrame, k: int = 5) -> DataFrame:
    """Past operations (context_id, op, tool, kind, confidence) of similar contexts: lanes good and bad, the best ``k`` of each.

    Bad ones carry what superseded them, from (bad, good).
    """
    hit = neighbours.join(operations, "context_id").withColumn("lane", F.when(F.col("kind") == "performed_well", "good").otherwise("bad"))
    s = hit.groupBy("query_id", "lane", "op", "tool").agg(F.sum(F.col("weight") * F.col("confidence")).alias("score"))
    w = Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "op")
    s = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    c = superseded.select(F.col("bad").alias("op"), F.col("good").alias("correction"))
    return s.join(c.groupBy("op").agg(F.min("correction").alias("correction")), "op", "left").withColumn("correction", F.when(F.col("lane") == "bad", F.col("correction")))


def hoist_templates(operations: DataFrame, templatizes: DataFrame) -> DataFrame:
    """Operations that a template (template, op) covers give way to it, at the best of their scores."""
    covered = operations.join(templatizes, "op")
    up = covered.groupBy("query_id", F.col("template").alias("op")).agg(F.max("score").alias("score")).withColumn("is_template", F.lit(True))
    rest = operations.join(templatizes.select("op").distinct(), "op", "left_anti").select("query_id", "op", "score").withColumn("is_template", F.lit(False))
    return up.unionByName(rest)


def cluster_flags(lanes: DataFrame, least: int = 3) -> DataFrame:
    """Tools with at least ``least`` distinct operations in a lane."""
    ops = lanes.groupBy("lane", "tool").agg(F.array_sort(F.collect_set("op")).alias("ops"))
    return ops.where(F.size("ops") >= least).select("lane", "tool", F.size("ops").alias("n"), F.array_join("ops", ",").alias("ops"))
