"""A training corpus from documents: five stages, each an operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint_folder, table
from tessera.llm.config_packing import pack
from tessera.llm.decontaminate import clean
from tessera.llm.jaccard_join import jaccard_groups
from tessera.llm.language_id import UNKNOWN, fit, is_held_out, predict
from tessera.llm.line_dedup import dedup_lines

#: A document this far from every profile is no text in a known language.
LEAST_SCORE = 0.25


def _own(docs: DataFrame):
    """What a row is told by, as ids may be missing or repeat: its doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is near a language profile; those without a letter go.

    Profiles are learned from the stage's own rows that have a doc_id and aren't held out.  Every row is judged by itself,
    also those without a doc_id or with that of another.
    """
    profiles = fit(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()).select("text", "lang"))
    found = predict(docs.select(_own(docs).alias("doc_id"), "text"), profiles)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(F.col("doc_id").alias("__own")).distinct()
    return docs.join(kept, _own(docs) == kept["__own"], "left_semi").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document of which nothing is left goes with its last line."""
    out = dedup_lines(docs)
    nothing = (F.col("n_kept") < F.col("n_lines")) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return out.where(~F.coalesce(nothing, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, of several texts under that id the one of the least hash.

    Rows without a doc_id all stay, though they may link others; so do rows without words, and rows that repeat both
    the doc_id and the text of the one that stays.
    """
    found = jaccard_groups(docs)
    named = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    first = found.where(named).groupBy("group").agg(F.min(F.struct("doc_id", "rid")).alias("f")).select("f.rid")
    kept = first.unionByName(found.where(~named).select("rid")).select(F.col("rid").alias("__own")).distinct()
    return docs.join(kept, _own(docs) == kept["__own"], "left_semi").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' ids in sequences."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Languages, fuzzy lines, shingle components and packing are beyond SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
