"""Ranked retrieval over the candidate table (query_id, list_name, weight, id, score, text).

All of it is keyed by query_id, so a batch of queries is one plan.  Ties are broken by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import CHANNEL_WEIGHTS, hybrid_score


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rank_lists(candidates: DataFrame) -> DataFrame:
    """Best score of an id in each list, ranked from 1."""
    best = candidates.groupBy("query_id", "list_name", "id").agg(F.max("score").alias("score"), F.max("weight").alias("weight"))
    w = Window.partitionBy("query_id", "list_name").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w))


def rrf(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion: (query_id, id, rrf, channels, primary).

    ``channels`` are the sorted prefixes of the lists that hold the id; ``primary`` is the first list by name.
    """
    ranked = rank_lists(candidates.repartition("query_id"))  # once, for lists, ranks and sums
    return ranked.groupBy("query_id", "id").agg(
        F.sum(F.coalesce("weight", F.lit(1.0)) / (k + F.col("rank"))).alias("rrf"),
        F.array_join(F.array_sort(F.collect_set(F.element_at(F.split("list_name", "_"), 1))), ",").alias("channels"),
        F.min("list_name").alias("primary"),
    )


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """``round`` as SQL has it, half away from zero."""
    unit = 10.0**places
    return np.copysign(np.floor(np.abs(x) * unit + 0.5), x) / unit + 0.0


def fuse(lists: list[tuple[str, float, np.ndarray, np.ndarray]], n: int, k: int = 60) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """``rrf`` of one query, whose lists (name, weight, positions, scores) are over ``n`` ids in ascending order: positions, rrf, channels, primary."""
    lists = sorted(lists, key=lambda x: x[0])
    total, held = np.zeros(n), np.zeros(n, np.int64)
    for i, (_, weight, at, score) in enumerate(lists):
        total[at[np.argsort(-score, kind="stable")]] += weight / (k + np.arange(1, len(at) + 1))
        held[at] |= 1 << i
    at = np.flatnonzero(held)
    codes, of = np.unique(held[at], return_inverse=True)
    among = [[x[0] for i, x in enumerate(lists) if code >> i & 1] for code in codes.tolist()]
    channels = pa.array([",".join(sorted({x.split("_")[0] for x in names})) for names in among], pa.string())
    return at, total[at], channels.take(pa.array(of)), pa.array([names[0] for names in among], pa.string()).take(pa.array(of))


def adaptive_k(df: DataFrame, by: list[str], score: str, tie: str, max_k: int = 20, min_k: int = 1, multiple: float = 2.0) -> DataFrame:
    """Rows of each group before its largest gap between neighbouring scores.

    Of the first ``max_k`` rows, those before the largest gap (the first of equal ones, not before ``min_k``)
    that is at least ``multiple`` times the mean gap; all of them if there is none.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    whole = Window.partitionBy(*by)
    out = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_k)
    out = out.withColumn("__gap", F.lag(score).over(order) - F.col(score))
    out = out.withColumn("__mean", F.avg("__gap").over(whole)).withColumn("__n", F.count("*").over(whole))
    fit = (F.col("rank") > min_k) & (F.col("__gap") >= F.col("__mean") * multiple) & (F.col("__mean") > 0) & (F.col("__gap") > 0)
    cut = F.max(F.when(fit, F.struct(F.col("__gap").alias("gap"), (-F.col("rank")).alias("at")))).over(whole)
    keep = F.when(F.col("__n") <= min_k, F.col("__n")).otherwise(F.coalesce(-cut["at"] - 1, F.col("__n")))
    return out.withColumn("__keep", keep).where(F.col("rank") <= F.col("__keep")).drop("__gap", "__mean", "__n", "__keep")


def two_stage(candidates: DataFrame, features: DataFrame, pool: int = 50, max_k: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """Fusion, the first ``pool`` per query, hybrid score, adaptive cut.

    ``features``: query_id, id, similarity, importance, decay, relevance and boost.
    """
    fused = top_k(rrf(candidates), ["query_id"], [F.desc("rrf"), "id"], pool, "fused_rank")
    scored = fused.join(features, ["query_id", "id"]).withColumn(
        "hybrid", hybrid_score("similarity", "importance", "decay", F.col("relevance"), weights=weights) + F.col("boost")
    )
    return adaptive_k(scored, ["query_id"], "hybrid", "id", max_k)


def with_channel(df: DataFrame, channel: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Candidates (query_id, id, score) as a list of a channel with its weight."""
    w = (CHANNEL_WEIGHTS | (weights or {}))[channel]
    return df.select("query_id", F.lit(channel).alias("list_name"), F.lit(float(w)).alias("weight"), "id", "score")


def within_budget(df: DataFrame, by: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows in order while their running size stays within a budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
