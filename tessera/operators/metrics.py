"""Ranking metrics and telemetry reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands of content length, [from, to).
LENGTH_BANDS = [("short", 0, 200), ("medium", 200, 1000), ("long", 1000, 4000), ("very_long", 4000, None)]


def _ranked(pairs: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    actual = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ideal = Window.partitionBy(*by).orderBy(F.desc("label"), tie)
    return pairs.withColumn("r", F.row_number().over(actual)).withColumn("ideal_r", F.row_number().over(ideal))


def ranking_metrics(pairs: DataFrame, by: list[str], score: str = "score", tie: str = "id", k: int = 10) -> DataFrame:
    """NDCG@k (gain 2^label - 1), precision@k and recall@k of each group; 0 where there is no positive."""
    r = _ranked(pairs, by, score, tie)
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col(at) + 1)).otherwise(0.0))
    hits = F.sum(F.when((F.col("r") <= k) & (F.col("label") > 0), 1).otherwise(0))
    out = r.groupBy(*by).agg(gain("r").alias("dcg"), gain("ideal_r").alias("ideal"), hits.alias("hits"), F.count_if(F.col("label") > 0).alias("positives"), F.count("*").alias("n"))
    return out.select(
        *by, "n", "positives", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        (F.col("hits") / F.least(F.lit(k), F.col("n"))).alias("precision"), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).otherwise(0.0).alias("recall"),
    )


def auc(pairs: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums with tied ranks averaged; 0.5 with one class only.

    Equal scores are counted first, so the window is over distinct scores.
    """
    c = pairs.groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("pos"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    s = c.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    value = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return s.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), value).otherwise(0.5).alias("auc"))


def length_band(length) -> F.Column:
    c = F.lit(None).cast("string")
    for name, low, high in reversed(LENGTH_BANDS):
        inside = (F.col(length) >= low) if high is None else (F.col(length) >= low) & (F.col(length) < high)
        c = F.when(inside, name).otherwise(c)
    return c


def bucket_metrics(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Per length band: means over contexts of the ranking metrics, AUC and mean scores by class."""
    b = pairs.withColumn("bucket", length_band("n_chars"))
    per = ranking_metrics(b, ["bucket", "context_id"], k=k).groupBy("bucket").agg(F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    means = b.groupBy("bucket").agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("label") > 0).alias("n_positive"),
        F.coalesce(F.avg(F.when(F.col("label") > 0, F.col("score"))), F.lit(0.0)).alias("score_mean_pos"), F.coalesce(F.avg(F.when(F.col("label") <= 0, F.col("score"))), F.lit(0.0)).alias("score_mean_neg"),
    )
    return per.join(auc(b, ["bucket"]), "bucket").join(means, "bucket")


def savings_curve(pairs: DataFrame, steps: int = 20) -> DataFrame:
    """At thresholds 0 to 1: rows at or over it, their precision, their share of all rows, and recall.

    Rows are first counted by the highest step they reach; the sums run over steps alone.
    """
    at = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(F.round(F.col("score") * steps, 9)))).cast("int")
    c = pairs.groupBy(at.alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("pos"))
    all_ = pairs.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    c = all_.join(c, "step", "left").fillna(0, ["n", "pos"])
    c = c.withColumn("above", F.sum("n").over(w)).withColumn("above_pos", F.sum("pos").over(w))
    whole = Window.partitionBy(F.lit(0))
    c = c.withColumn("total", F.sum("n").over(whole)).withColumn("positives", F.sum("pos").over(whole)).where("step >= 0")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return c.select((F.col("step") / steps).alias("threshold"), F.col("above").alias("accepted"), ratio("above_pos", "above").alias("precision"), ratio("above", "total").alias("savings"), ratio("above_pos", "positives").alias("recall"))


def retrieval_recall(results: DataFrame) -> DataFrame:
    """Share of evidence that was retrieved, any and all; 1 where there is no evidence. (query_id, retrieved, evidence)"""
    hit = F.size(F.array_intersect("retrieved", "evidence"))
    n = F.size(F.array_distinct("evidence"))
    return results.select(
        "query_id", F.when(n == 0, 1.0).otherwise(hit / n).alias("recall"), F.when(n == 0, 1.0).otherwise((hit > 0).cast("double")).alias("recall_any"), F.when(n == 0, 1.0).otherwise((hit == n).cast("double")).alias("recall_all")
    )


def binary_ndcg(results: DataFrame, by: list[str], k: int) -> DataFrame:
    """NDCG@k with binary relevance, the ideal order being that of the retrieved top k. (rank from 1, label)"""
    top = results.where(F.col("rank") <= k)
    w = Window.partitionBy(*by).orderBy(F.desc("label"), "rank")
    top = top.withColumn("ideal_r", F.row_number().over(w))
    s = top.groupBy(*by).agg(F.sum(F.col("label") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("label") / F.log2(F.col("ideal_r") + 1)).alias("ideal"))
    return s.select(*by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def reuse_rate(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.round(F.avg(F.col("reused").cast("double")), 4).alias("reuse_rate"), F.count("*").alias("calls"))


def channel_contribution(log: DataFrame) -> DataFrame:
    """Per channel of hits map<string,int>: all hits, and calls with any."""
    each = log.select(F.explode("hits").alias("channel", "n"))
    return each.groupBy("channel").agg(F.sum("n").cast("long").alias("hits"), F.count_if(F.col("n") > 0).alias("calls"))


def within_days(log: DataFrame, now: str, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days``; rows without a time stay."""
    return log.where(F.col(ts).isNull() | (F.col(ts) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))))
