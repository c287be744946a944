"""Deduplication of records within their source, and greedy clustering.

Both rules are greedy and depend on order, so a group's records pass one by one, in order, by what was kept of the group
so far: a task holds the vectors that were kept, not the group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import keyed_fold

THRESHOLD, LEAST_GROUP, LEAST_CHARS = 0.15, 5, 20


class _Kept:
    """Unit vectors in order, in an array that grows by doubling."""

    def __init__(self):
        self.rows, self.size, self.n = np.zeros((0, 0)), np.zeros(0, np.int64), 0

    def similar(self, v: list | None) -> tuple[np.ndarray, np.ndarray]:
        """The vector at length 1 (empty if it has no direction), and its cosines to what is kept; 0 with vectors of another length."""
        x = np.array([] if v is None or None in v else v, np.float64)
        size = np.sqrt(x @ x)
        x = x / size if size > 0 else x[:0]
        near = np.zeros(self.n)
        if self.n and len(x):
            near[:] = self.rows[: self.n, : len(x)] @ x if len(x) <= self.rows.shape[1] else self.rows[: self.n] @ x[: self.rows.shape[1]]
            near[self.size[: self.n] != len(x)] = 0
        return x, near

    def add(self, x: np.ndarray) -> None:
        if self.n == len(self.rows) or len(x) > self.rows.shape[1]:
            more = np.zeros((max(16, 2 * self.n), max(self.rows.shape[1], len(x))))
            more[: self.n, : self.rows.shape[1]] = self.rows[: self.n]
            self.rows, self.size = more, np.append(self.size[: self.n], np.zeros(len(more) - self.n, np.int64))
        self.rows[self.n, : len(x)], self.size[self.n] = x, len(x)
        self.n += 1


def source_groups(records: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    return records.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def savings(records: DataFrame, large: int = 20, share: float = 0.4) -> DataFrame:
    """One row: records, groups, and what deduplication of groups over ``large`` may save."""
    g = records.groupBy("source_file").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("records"), F.count("*").alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > large, F.floor(share * F.col("n")))), F.lit(0)).alias("may_save"))


class DedupFold:
    def __init__(self, threshold: float):
        self.threshold, self.kept = threshold, _Kept()

    def row(self, row: dict) -> list[tuple]:
        x, near = self.kept.similar(row["embedding"])
        ok = row["n"] >= LEAST_CHARS and not (len(near) and float((1 - near).min()) < self.threshold)
        if ok:
            self.kept.add(x)
        return [(row["source_file"], row["id"], ok)]

    def end(self) -> list[tuple]:
        return []


def dedup_sources(records: DataFrame, threshold: float = THRESHOLD, least_group: int = LEAST_GROUP) -> DataFrame:
    """(source_file, id, kept): greedy, longest text first (ties by id); a record goes if it is short or its cosine distance to a kept one is below the threshold."""
    groups = source_groups(records, least_group).select("source_file")
    rows = records.join(groups, "source_file", "left_semi")
    rows = rows.select("source_file", "id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("longest", -F.col("n"))
    return keyed_fold(rows, ["source_file"], ["longest", "id"], lambda: DedupFold(threshold), f"source_file string, id {dict(records.dtypes)['id']}, kept boolean")


def dedup_report(deduplicated: DataFrame) -> DataFrame:
    """(source_file, records, kept, removed) of what ``dedup_sources`` gave; the row of a null source has the totals."""
    g = deduplicated.rollup("source_file").agg(F.count("*").alias("records"), F.count_if("kept").alias("kept"), F.grouping("source_file").alias("__all"))
    return g.where((F.col("__all") == 1) | F.col("source_file").isNotNull()).select("source_file", "records", "kept", (F.col("records") - F.col("kept")).alias("removed"))


class LeaderFold:
    def __init__(self, threshold: float):
        self.threshold, self.kept, self.ids = threshold, _Kept(), []

    def row(self, row: dict) -> list[tuple]:
        x, near = self.kept.similar(row["embedding"])
        at = np.flatnonzero(near >= self.threshold)
        if not len(at):
            self.kept.add(x)
            self.ids.append(row["id"])
        return [(row["domain"], row["id"], self.ids[at[0]] if len(at) else row["id"])]

    def end(self) -> list[tuple]:
        return []


def leader_clusters(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(domain, id, leader): each row in order of id joins the first leader that is at least ``threshold`` similar, or leads."""
    kinds = dict(rows.dtypes)
    own = rows.select("domain", "id", F.col("embedding").cast("array<double>").alias("embedding"))
    return keyed_fold(own, ["domain"], ["id"], lambda: LeaderFold(threshold), f"domain {kinds['domain']}, id {kinds['id']}, leader {kinds['id']}")
