"""Search over several channels: one cosine list for each view of a query, keywords, the graph and ratings of contexts.

A metadata filter (tessera.functions.filters) narrows all channels to the same ids before anything is ranked.  Channels
without input are left out.  All of it is keyed by query_id; a query that no channel answers has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.filters import Tree, filtered, parsed
from tessera.functions.scoring import CHANNEL_WEIGHTS
from tessera.functions.text import preview
from tessera.operators import feedback, index, keywords, kg, ranking, vector

#: Hits of a view, and of these the seeds of the graph channel.
PER_VIEW, SEEDS = 50, 3


def filtered_top_k(queries: DataFrame, vectors: DataFrame, tree: Tree, k: int = 10) -> DataFrame:
    """``vector.cosine_top_k`` among the vectors that pass; the filter reaches the scan."""
    return vector.cosine_top_k(queries, filtered(vectors, tree), k)


def fused(queries: DataFrame, vectors: DataFrame, lists: Callable[[pa.Array, np.ndarray], list[tuple]], pool: int | None = None, places: int = 9, k: int = 60) -> DataFrame:
    """(query_id, id, similarity, rrf, channels, primary): ``ranking.rrf`` of the lists that ``lists`` makes of all ids and their similarity to a query.

    Lists are ranked and fused where the query meets the vectors (``vector.per_query``), so candidates aren't shuffled.  ``rrf`` is rounded; of a
    ``pool`` the first rows by it, ties by id.
    """

    def made(ids: pa.Array, similarity: np.ndarray) -> list[pa.Array]:
        at, score, *names = ranking.fuse(lists(ids, similarity), len(ids), k)
        score = ranking.half_up(score, places)
        if pool is not None and len(at) > pool:
            few = np.flatnonzero(score >= np.partition(score, -pool)[-pool])
            few = few[np.argsort(-score[few], kind="stable")[:pool]]
            at, score, names = at[few], score[few], [x.take(pa.array(few)) for x in names]
        return [ids.take(pa.array(at)), pa.array(similarity[at]), pa.array(score), *names]

    return vector.per_query(queries, vectors, made, f"id {vectors.schema['id'].dataType.simpleString()}, similarity double, rrf double, channels string, primary string")


def top_k_by_filter(queries: DataFrame, vectors: DataFrame, k: int = 10, most: int = 1000) -> DataFrame:
    """The same where each query (query_id, view, query, filter) has a filter of its own, as JSON; null lets all pass.

    There may be any number of queries but no more than ``most`` different filters.  A vector that no filter lets pass is not scored.
    """
    trees = [r[0] for r in queries.select("filter").distinct().limit(most + 1).collect()]
    if len(trees) > most:
        raise ValueError(f"more than {most} different filters: split the queries")
    parts = [vector.cosine_top_k(queries.where(F.col("filter").eqNullSafe(t)), filtered(vectors, t), k) for t in trees]
    if not parts:
        return vector.cosine_top_k(queries, vectors, k)
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return ranking.top_k(scored.drop("rank"), ["query_id", "view"], [F.desc("similarity"), "id"], k)


def cosine_lists(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Hits of views (query_id, view, id, similarity) as hits on their owners, or on themselves: the best similarity, rounded to 3."""
    o = owners.select("id", F.col("owner_id").cast("string").alias("owner_id")).distinct()
    h = hits.join(o, "id", "left").withColumn("id", F.coalesce("owner_id", F.col("id").cast("string")))
    return h.groupBy("query_id", "view", "id").agg(F.round(F.max("similarity"), 3).alias("similarity"))


def multi_channel_search(
    queries: DataFrame, vectors: DataFrame, *, tree: Tree = None, asked: DataFrame | None = None, postings: DataFrame | None = None, idfs: DataFrame | None = None,
    triples: DataFrame | None = None, seeds: DataFrame | None = None, neighbours: DataFrame | None = None, ratings: DataFrame | None = None,
    weights: dict[str, float] | None = None, per_view: int = PER_VIEW, by: index.Index | None = None,
) -> DataFrame:
    """Candidates (query_id, list_name, weight, id, score) of all channels, for ``ranking.rrf``.

    queries (query_id, view, query) against vectors (id, embedding, owner_id and fields of the filter); asked (query_id,
    keyword) with postings and idfs; triples, from seeds (query_id, id) or else the first ``SEEDS`` of each view; ratings
    of neighbours (query_id, context_id, weight).  ``by`` searches an index instead of all vectors; its rows must have the filter's fields.
    """
    allowed = None
    if parsed(tree):
        passing = filtered(vectors, tree)
        allowed = passing.select(F.coalesce(F.col("owner_id").cast("string"), F.col("id").cast("string")).alias("id")).distinct()
    if by is None:
        hits = filtered_top_k(queries, vectors, tree, per_view)
    else:
        hits = index.search(index.Index(by.centroids, filtered(by.rows, tree), by.parts), queries, per_view)
    cosine = cosine_lists(hits, vectors)
    w = CHANNEL_WEIGHTS | (weights or {})
    name = F.concat(F.lit("cosine_"), F.col("view").cast("string"))
    parts = [cosine.select("query_id", name.alias("list_name"), F.lit(float(w["cosine"])).alias("weight"), "id", F.col("similarity").alias("score"))]

    def passing_only(rows: DataFrame, column: str) -> DataFrame:
        return rows if allowed is None else rows.join(allowed.withColumnRenamed("id", "__ok"), F.col(column).cast("string") == F.col("__ok"), "left_semi")

    def add(found: DataFrame, channel: str) -> None:
        parts.append(ranking.with_channel(found.withColumn("id", F.col("id").cast("string")), channel, weights))

    if asked is not None:
        add(passing_only(keywords.keyword_channel(asked, postings, idfs), "id"), "keyword")
    if triples is not None:
        first = ranking.top_k(cosine, ["query_id", "view"], [F.desc("similarity"), "id"], SEEDS)
        known = cosine.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
        near = first.select("query_id", "id").distinct().join(known, ["query_id", "id"])
        if seeds is not None:  # a query's own seeds replace those of its hits
            own = seeds.select("query_id", F.col("id").cast("string").alias("id")).distinct()
            own = own.join(known, ["query_id", "id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
            near = near.join(own.select("query_id").distinct(), "query_id", "left_anti").unionByName(own)
        add(passing_only(kg.graph_channel(near, triples), "id"), "graph")
    if neighbours is not None:
        rated = passing_only(ratings, "memory_id")  # before each meets all queries
        scored = feedback.neighbourhood_scores(neighbours, rated).withColumn("recall", F.round("recall", 9))
        add(feedback.context_channel(scored), "context")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project_hits(hits: DataFrame, records: DataFrame, triples: DataFrame) -> DataFrame:
    """Hits (query_id, id, source, score) as what an agent reads: the record's preview, or the fact as prose; null where the id is unknown.

    Records: id, summary, content.  Triples: as tessera.schemas.  A source other than ``triple`` is a record.
    """
    r = records.select(F.col("id").alias("__r"), preview("summary", "content").alias("summary_text")).dropDuplicates(["__r"])
    t = triples.select(F.col("id").alias("__t"), kg.statement_text().alias("statement_text")).dropDuplicates(["__t"])
    fact = F.col("source") == "triple"
    out = hits.join(r, (F.col("id") == F.col("__r")) & ~fact, "left").join(t, (F.col("id") == F.col("__t")) & fact, "left")
    return out.select("query_id", "id", "source", F.when(fact, F.col("statement_text")).otherwise(F.col("summary_text")).alias("text"), "score")
