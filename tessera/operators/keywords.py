"""Keyword postings, inverse document frequencies and the keyword channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import idf


def add_keywords(postings: DataFrame, new: DataFrame) -> DataFrame:
    """Postings with new ones merged in: per (entity_id, keyword) the latest added_at wins."""
    both = postings.unionByName(new)
    return both.groupBy("entity_id", "keyword").agg(F.max_by("source", "added_at").alias("source"), F.max("added_at").alias("added_at"))


def entity_keywords(postings: DataFrame) -> DataFrame:
    """Keywords of each entity in order of added_at."""
    w = Window.partitionBy("entity_id").orderBy("added_at", "keyword")
    return postings.withColumn("position", F.row_number().over(w)).select("entity_id", "keyword", "position")


def keyword_idf(postings: DataFrame, records: DataFrame) -> DataFrame:
    """(keyword, freq, idf): distinct active records per keyword, rounded to 6.

    Postings: entity_id and keyword, or keywords, an array.  Arrays are the lighter form: keywords are counted where they are, and
    only entities with several rows are told apart again.
    """
    active = records.where("status = 'active'").select(F.col("id").alias("entity_id")).distinct()
    if "keywords" in postings.columns:
        rows = postings.groupBy("entity_id").agg((F.count("*") > 1).alias("__several"))
        known = active.join(rows, "entity_id").hint("shuffle_hash")  # ids are built, keywords stream past them unsorted
        hit = postings.join(known, "entity_id").select(F.when(F.col("__several"), F.col("entity_id")).alias("__e"), F.explode(F.array_distinct("keywords")).alias("keyword"))
        each = hit.groupBy("keyword", "__e").agg(F.count("*").alias("__n"))
        freq = each.groupBy("keyword").agg(F.sum(F.when(F.col("__e").isNull(), F.col("__n")).otherwise(1)).alias("freq"))
    else:
        freq = postings.join(active.hint("shuffle_hash"), "entity_id", "left_semi").groupBy("keyword").agg(F.countDistinct("entity_id").alias("freq"))
    n = active.agg(F.count("*").alias("n"))
    return freq.crossJoin(F.broadcast(n)).select("keyword", "freq", F.round(idf("n", "freq"), 6).alias("idf"))  # n is one row


def lookup_idf(keywords: DataFrame, idfs: DataFrame) -> DataFrame:
    """IDF of each requested keyword, 0 if unseen."""
    return keywords.join(idfs.select("keyword", "idf"), "keyword", "left").select("keyword", F.coalesce("idf", F.lit(0.0)).alias("idf"))


def lookup_entities(keywords: DataFrame, postings: DataFrame, limit: int = 50) -> DataFrame:
    """(keyword, entity_id): at most ``limit`` entities of each keyword, by id; keywords match in lower case."""
    p = postings.select(F.lower("keyword").alias("keyword"), "entity_id")
    hit = p.join(keywords.select(F.lower("keyword").alias("keyword")).distinct(), "keyword", "left_semi")
    w = Window.partitionBy("keyword").orderBy("entity_id")  # equal rows share a rank, so that tasks cut their own rows before they are told apart
    return hit.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= limit).distinct()


def keyword_channel(queries: DataFrame, postings: DataFrame, idfs: DataFrame, least_idf: float = 0.0, limit: int = 50) -> DataFrame:
    """(query_id, id, score): sum of IDF over matched keywords of queries (query_id, keyword).

    If none of a query's keywords has an IDF above 0, each match counts 1.  Keywords below ``least_idf``
    are dropped before the lookup.
    """
    asked = queries.select("query_id", F.lower("keyword").alias("keyword")).distinct().join(idfs.select("keyword", "idf"), "keyword", "left")
    asked = asked.withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    cold = F.max("idf").over(Window.partitionBy("query_id")) <= 0
    asked = asked.withColumn("weight", F.when(cold, F.lit(1.0)).otherwise(F.col("idf"))).withColumn("cold", cold)
    asked = asked.where(F.col("cold") | (F.col("idf") >= least_idf))
    hit = lookup_entities(queries.select("keyword"), postings, limit).select("keyword", "entity_id")
    return asked.join(hit, "keyword").groupBy("query_id", F.col("entity_id").alias("id")).agg(F.sum("weight").alias("score"))


def count_observations(observed: DataFrame) -> DataFrame:
    """(keyword, freq): occurrences, each record once per keyword."""
    return observed.select("record_id", "keyword").distinct().groupBy("keyword").agg(F.count("*").alias("freq"))
