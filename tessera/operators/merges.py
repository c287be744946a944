"""Chains of merged entities, and proposals of edges between what they lead to.

A tombstone (id, into) says that an entity went into another, which may have gone into a third.  Chains are resolved
by pointer jumping: each round every pointer is replaced by its target's pointer, so a chain of n steps takes
about log2(n) rounds, however many chains there are.  Chains that run in a circle end nowhere; all that lead into one resolve to
the circle's least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.state import upsert_candidates

#: Fixed value: weight of a proposal that has none.
WEIGHT = 0.7


def _cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the shared checkpoint folder if the session has one, else as a cached table."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True) if sc._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def _pointers(df: DataFrame, at: str, to: str) -> DataFrame:
    return df.select(F.col("id").alias(at), F.col("into").alias(to))


def canonical_ids(tombstones: DataFrame) -> DataFrame:
    """(id, canonical) of every merged entity; of several tombstones of one id the least target counts, one into itself is none."""
    first = tombstones.where("id IS NOT NULL AND into IS NOT NULL AND id <> into").groupBy("id").agg(F.min("into").alias("into"))
    first = _cut(first)
    ended, moving = first.where("false"), first
    left, before = first.count(), None
    while left and left != before:  # a chain of n steps has chains of all lengths up to n in it: where no pointer ends, none that is left does
        # pointers of all, those that have ended too: a target without one is no tombstone, and the end
        step = _cut(moving.join(_pointers(ended.unionByName(moving), "into", "next"), "into", "left").select("id", "into", "next"))
        ended = ended.unionByName(step.where("next IS NULL").select("id", "into"))
        moving = step.where("next IS NOT NULL").select("id", F.col("next").alias("into"))
        left, before = moving.count(), left
    if left:
        ended = ended.unionByName(_circles(first, moving))
    return ended.select("id", F.col("into").alias("canonical"))


def _circles(first: DataFrame, at: DataFrame) -> DataFrame:
    """Ids that lead into a circle, with its least id; ``at`` has a place ahead for each, and no other ids.

    The places ahead become fewer until they are those on circles; then each place learns the least id among more and more
    steps, until none learns of a lesser one.
    """
    places, n = _cut(at.select("into").distinct()), None
    while n != (now := places.count()):
        at, n = _cut(at.join(_pointers(at, "into", "next"), "into").select("id", F.col("next").alias("into"))), now
        places = _cut(at.select("into").distinct())
    around = _cut(first.join(places.select(F.col("into").alias("id")), "id", "left_semi").withColumn("least", F.least("id", "into")))
    lesser = True
    while lesser:
        ahead = around.select(F.col("id").alias("into"), F.col("into").alias("next"), F.col("least").alias("other"))
        step = _cut(around.join(ahead, "into").select("id", F.col("next").alias("into"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("lesser")))
        lesser, around = bool(step.where("lesser").limit(1).count()), step.drop("lesser")
    return at.join(around.select(F.col("id").alias("into"), "least"), "into").select("id", F.col("least").alias("into"))


def follow(df: DataFrame, col: str, canonical: DataFrame) -> DataFrame:
    """``df`` with merged ids of ``col`` replaced by what they lead to."""
    c = canonical.select(F.col("id").alias("__id"), F.col("canonical").alias("__canonical"))
    return df.join(c, F.col(col) == F.col("__id"), "left").withColumn(col, F.coalesce("__canonical", col)).select(*df.columns)


def judge_proposals(proposals: DataFrame, entities: DataFrame, tombstones: DataFrame, triples: DataFrame) -> DataFrame:
    """Proposals (a, b, w, ctx) with canonical ends and a verdict: phantom, self_loop, connected, repeated or inserted.

    Ends are resolved through merges before they are looked up among active entities.  A pair that the same context proposes
    again, in either direction, is repeated; the greater weight, then the least ends as given, is the first.  No weight is ``WEIGHT``.
    """
    canonical = canonical_ids(tombstones)
    p = proposals.select(F.col("a").alias("from_given"), F.col("b").alias("to_given"), "a", "b", F.coalesce("w", F.lit(WEIGHT)).cast("double").alias("w"), "ctx")
    # what an id leads to and whether that is known, looked up once for each end
    known = entities.where("status = 'active'").select(F.col("id").alias("canonical"), F.lit(True).alias("known")).distinct()
    merged = canonical.join(known, "canonical", "left").select("id", "canonical", F.coalesce("known", F.lit(False)).alias("known"))
    own = known.withColumn("id", F.col("canonical")).join(canonical.select("id"), "id", "left_anti").select("id", "canonical", "known")
    ends = merged.unionByName(own)
    for side in ("a", "b"):
        end = ends.select(F.col("id").alias("__id"), F.col("canonical").alias("__canonical"), F.col("known").alias(f"__{side}"))
        p = p.join(end, F.col(side) == F.col("__id"), "left").withColumn(side, F.coalesce("__canonical", side)).drop("__id", "__canonical")
    p = p.withColumn("from_entity", F.least("a", "b")).withColumn("to_entity", F.greatest("a", "b"))
    edges = triples.where("valid_to IS NULL OR valid_to = ''").select(F.least("subject", "object").alias("from_entity"), F.greatest("subject", "object").alias("to_entity")).distinct()
    p = p.join(edges.withColumn("__edge", F.lit(True)), ["from_entity", "to_entity"], "left")
    bad = F.when(~F.coalesce("__a", F.lit(False)) | ~F.coalesce("__b", F.lit(False)), "phantom").when(F.col("a") == F.col("b"), "self_loop").when(F.col("__edge"), "connected")
    p = p.withColumn("__bad", bad)
    best = F.struct((-F.col("w")).alias("w"), "from_given", "to_given")
    # bad ones compare with none: they are spread by their own ends, so that no task holds all of a frequent pair
    spread = F.when(F.col("__bad").isNotNull(), F.xxhash64("from_given", "to_given", "ctx", "w"))
    first = F.min(best).over(Window.partitionBy("from_entity", "to_entity", "ctx", "__bad", spread))
    verdict = F.coalesce("__bad", F.when(best == first, "inserted").otherwise("repeated"))
    return p.select("from_given", "to_given", "ctx", "w", "from_entity", "to_entity", verdict.alias("verdict"))


def propose_edges(proposals: DataFrame, entities: DataFrame, tombstones: DataFrame, triples: DataFrame) -> DataFrame:
    """(from_entity, to_entity, score, shared_context_count): the candidates that the accepted proposals add up to."""
    ok = judge_proposals(proposals, entities, tombstones, triples).where("verdict = 'inserted'")
    return upsert_candidates(ok.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b"), "w", "ctx"), triples)
