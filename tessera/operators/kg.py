"""Reads of the temporal knowledge graph.

``triples`` and ``entities`` follow tessera.schemas.  Times are ISO strings and compare as strings.  A
fact holds at a date within [valid_from, valid_to], both ends included; missing ends are open.
Every operator takes tables of probes, so that one question is the case of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import degree_damping
from tessera.operators.merges import _cut
from tessera.schemas import HIDDEN_PREDICATES, SKIP_PREDICATES


def holds_at(date: str | Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Whether a fact holds at a date; a null date lets every fact pass."""
    d = F.lit(date) if isinstance(date, str) else date
    f, t = F.col(valid_from), F.col(valid_to)
    return d.isNull() | ((f.isNull() | (f <= d)) & (t.isNull() | (t >= d)))


def is_current(valid_to: str = "valid_to", empty_too: bool = False) -> Column:
    c = F.col(valid_to).isNull()
    return c | (F.col(valid_to) == "") if empty_too else c


def resolve_aliases(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """``col`` replaced by the canonical id of its alias, one hop."""
    a = aliases.select(F.col("alias").alias("__alias"), F.col("canonical_id").alias("__canonical")).dropDuplicates(["__alias"])
    out = df.join(a, F.col(col) == F.col("__alias"), "left")
    return out.withColumn(col, F.coalesce("__canonical", col)).select(*df.columns)


def statement_text(subject: str = "subject", predicate: str = "predicate", obj: str = "object", statement: str = "statement") -> Column:
    """A fact as prose: its statement, the `what` of a JSON statement, or the fact itself."""
    s = F.col(statement)
    what = F.get_json_object(F.when(F.startswith(F.ltrim(s), F.lit("{")), s), "$.what")
    plain = F.concat(F.col(subject), F.lit(" "), F.regexp_replace(predicate, "_", " "), F.lit(" "), F.col(obj), F.lit("."))
    return F.coalesce(F.nullif(F.trim(what), F.lit("")), F.nullif(F.trim(s), F.lit("")), plain)


def query_entity(probes: DataFrame, triples: DataFrame, entities: DataFrame, direction: str = "both") -> DataFrame:
    """Facts of each probe (entity, as_of).  A fact from an entity to itself comes out once for either direction.

    The join is on the entity with the date as a residual, so it stays a hash or merge join.
    """
    names = entities.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    parts = []
    for way, near, far in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (way, "both"):
            hit = triples.join(probes, (F.col(near) == F.col("entity"))).where(holds_at(F.col("as_of")))
            hit = hit.join(names, F.col(far) == F.col("__id"))
            parts.append(
                hit.select(
                    "entity", "as_of", F.lit(way).alias("direction"), F.col("id").alias("triple_id"), "predicate",
                    F.col("__name").alias("other"), "valid_from", "valid_to", "confidence", is_current().alias("current"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query_relationship(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    """All facts of a predicate with the names of both ends."""
    s = entities.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    hit = triples.where((F.col("predicate") == predicate) & holds_at(F.lit(as_of).cast("string")))
    return hit.join(s, "subject").join(o, "object").select(
        F.col("id").alias("triple_id"), "subject_name", "predicate", "object_name", "valid_from", "valid_to", is_current().alias("current")
    )


#: Facts of a timeline that are sent to all tasks to be named.
MOST_NAMED = 10_000


def timeline(triples: DataFrame, entities: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    """The oldest ``limit`` facts, of an entity or of all; facts without a start come last, ties by id.

    Only four times ``limit`` of the oldest facts meet the entities.  If too few of them have both ends, all facts do.
    """
    if entity is not None:
        triples = triples.where((F.col("subject") == entity) | (F.col("object") == entity))
    s = entities.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    order = [F.asc_nulls_last("valid_from"), "id"]
    out = None
    if limit <= MOST_NAMED // 4:
        oldest = _cut(triples.orderBy(*order).limit(4 * limit))
        named = _cut(F.broadcast(F.broadcast(oldest).join(s, "subject")).join(o, "object").orderBy(*order).limit(limit))
        out = named if named.count() == limit or oldest.count() < 4 * limit else None
    if out is None:
        out = triples.join(s, "subject").join(o, "object").orderBy(*order).limit(limit)
    return out.select(F.col("id").alias("triple_id"), "subject_name", "predicate", "object_name", "valid_from", "valid_to", is_current().alias("current"))


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: counts of entities, facts, current and expired facts, and the sorted predicates."""
    e = entities.agg(F.count("*").alias("entities"))
    t = triples.agg(
        F.count("*").alias("triples"), F.count_if(is_current()).alias("current_facts"), F.count_if(~is_current()).alias("expired_facts"),
        F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"),
    )
    return e.crossJoin(t)  # one row each


def degrees(triples: DataFrame) -> DataFrame:
    """(id, degree) over current facts; a fact from an entity to itself counts twice."""
    now = triples.where(is_current(empty_too=True))
    ends = now.select(F.explode(F.array("subject", "object")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def edge_counts(triples: DataFrame) -> DataFrame:
    """(id, edges) over current facts; a fact from an entity to itself counts once."""
    ends = triples.where(is_current()).select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("edges"))


def list_entities(entities: DataFrame, status: str = "active", kind: str | None = None) -> DataFrame:
    out = entities.where(F.col("status") == status)
    out = out if kind is None else out.where(F.col("kind") == kind)
    return out.orderBy(F.desc("importance"), F.desc("last_touched"), "id")


def get_entities(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Point lookups: active entities among ``ids`` (id)."""
    return entities.where("status = 'active'").join(ids.select("id").distinct(), "id", "left_semi")


def without_bookkeeping(facts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts to show, and by key how many were hidden."""
    hidden = F.col("predicate").isin(HIDDEN_PREDICATES)
    return facts.where(~hidden), facts.groupBy(*by).agg(F.count_if(hidden).alias("hidden"), F.count_if(~hidden).alias("shown"))


def unverbalised(triples: DataFrame, limit: int) -> DataFrame:
    """Facts that should have a statement and have none, by id."""
    return triples.where(F.col("statement").isNull() & ~F.col("predicate").isin(SKIP_PREDICATES)).orderBy("id").limit(limit)


def created_under(triples: DataFrame, context: str) -> DataFrame:
    return triples.where((F.col("creation_context_id") == context) & is_current(empty_too=True))


def closure(triples: DataFrame, seeds: DataFrame, predicate: str = "is_a", depth: int = 5) -> DataFrame:
    """(id, ancestor, depth): everything reached from ``seeds`` (id) over current facts, at its least depth; seeds at 0.

    One join and one aggregation for each level; only rows of the last level find anything to join.  The others are dealt by
    their own id: without a key they would all come to one task.
    """
    up = triples.where((F.col("predicate") == predicate) & is_current()).select(F.col("subject").alias("__s"), F.col("object").alias("__o")).distinct()
    up = up.withColumn("__last", F.lit(True))
    reached = seeds.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        last = F.col("depth") == d - 1
        step = reached.join(up, (F.when(last, F.col("ancestor")).otherwise(F.col("id")) == F.col("__s")) & (last == F.col("__last")), "left")
        own = F.struct("ancestor", "depth")
        found = F.when(F.col("__o").isNotNull(), F.array(own, F.struct(F.col("__o").alias("ancestor"), F.lit(d).alias("depth")))).otherwise(F.array(own))
        step = step.select("id", F.explode(found).alias("r"))
        reached = step.groupBy("id", F.col("r.ancestor").alias("ancestor")).agg(F.min("r.depth").alias("depth"))
    return reached


def is_subclass_of(triples: DataFrame, seeds: DataFrame, allowed: DataFrame, depth: int = 5) -> DataFrame:
    """Seeds of which an ancestor (or the seed itself) is among ``allowed`` (id)."""
    up = closure(triples, seeds, depth=depth)
    return up.join(allowed.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()


def resolve_profile(triples: DataFrame, profiles: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(id, slots, tools): slots of the nearest ancestor that sets them, and the tools of all."""
    up = closure(triples, seeds, depth=depth).join(profiles.withColumnRenamed("id", "ancestor"), "ancestor")
    return up.groupBy("id").agg(
        F.min_by("slots", F.when(F.col("slots").isNotNull(), F.struct("depth", "ancestor"))).alias("slots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tools", F.array().cast("array<string>")))))).alias("tools"),
    )


def cardinality_violations(triples: DataFrame, cardinality: DataFrame) -> DataFrame:
    """Current facts that break their predicate's cardinality (predicate, cardinality)."""
    now = triples.where(is_current()).join(cardinality, "predicate")
    # counts combine before they are dealt, and only keys of several facts are joined back: no task holds all facts of a key
    for end in ("subject", "object"):
        several = now.groupBy(end, "predicate").agg(F.count("*").alias(f"per_{end}")).where(F.col(f"per_{end}") > 1)
        now = now.join(several, [end, "predicate"], "left").withColumn(f"per_{end}", F.coalesce(f"per_{end}", F.lit(1).cast("long")))
    one_object = F.col("cardinality").isin("many-to-one", "one-to-one") & (F.col("per_subject") > 1)
    one_subject = F.col("cardinality").isin("one-to-many", "one-to-one") & (F.col("per_object") > 1)
    return now.where(one_object | one_subject).select(F.col("id").alias("triple_id"), "subject", "predicate", "object", "per_subject", "per_object")


def contradictions(new: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs of a new fact and a current one with the same subject and predicate and another object; not for is_a."""
    old = triples.where(is_current() & (F.col("predicate") != "is_a")).select("subject", "predicate", F.col("id").alias("existing_id"), F.col("object").alias("existing_object"))
    return new.select(F.col("id").alias("new_id"), "subject", "predicate", "object").join(old, ["subject", "predicate"]).where("object <> existing_object")


def kind_violations(new: DataFrame, entities: DataFrame, constraints: DataFrame) -> DataFrame:
    """New facts whose ends are of kinds that the predicate's lists don't admit; an empty list admits all."""
    s = entities.select(F.col("id").alias("subject"), F.col("kind").alias("subject_kind"))
    o = entities.select(F.col("id").alias("object"), F.col("kind").alias("object_kind"))
    out = new.join(s, "subject").join(o, "object").join(constraints, "predicate")
    fine = lambda kinds, kind: (F.coalesce(F.size(kinds), F.lit(0)) == 0) | F.array_contains(F.col(kinds), F.col(kind))
    return out.where(~(fine("subject_kinds", "subject_kind") & fine("object_kinds", "object_kind"))).select(F.col("id").alias("triple_id"), "predicate", "subject_kind", "object_kind")


def compatible_predicates(pairs: DataFrame, constraints: DataFrame, limit: int = 12) -> DataFrame:
    """For pairs of kinds (a_kind, b_kind), the first ``limit`` predicates that admit them."""
    admits = lambda kinds, kind: (F.coalesce(F.size(kinds), F.lit(0)) == 0) | F.array_contains(F.col(kinds), F.col(kind))
    both = pairs.select("a_kind", "b_kind").distinct().join(constraints, admits("subject_kinds", "a_kind") & admits("object_kinds", "b_kind"))
    by = Window.partitionBy("a_kind", "b_kind").orderBy("predicate")
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("a_kind", "b_kind", "predicate", "rank")


def missing_endpoints(new: DataFrame, entities: DataFrame) -> DataFrame:
    """New facts with an end that isn't an active entity."""
    known = entities.where("status = 'active'").select(F.col("id").alias("missing"))
    ends = new.select(F.col("id").alias("triple_id"), F.explode(F.array("subject", "object")).alias("missing"))
    return ends.join(known, "missing", "left_anti").select("triple_id", "missing")


def orphans(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, side): ids of ``a`` that ``b`` lacks, and the other way round."""
    left = a.select("id").join(b.select("id"), "id", "left_anti").withColumn("side", F.lit("left_only"))
    return left.unionByName(b.select("id").join(a.select("id"), "id", "left_anti").withColumn("side", F.lit("right_only")))


def graph_channel(seeds: DataFrame, triples: DataFrame, floor: float = 0.2, share: float = 0.8) -> DataFrame:
    """Neighbours of seeds (query_id, id, similarity): max(floor, share * similarity) damped by the neighbour's degree; the best per neighbour."""
    now = triples.where(is_current(empty_too=True))
    ways = now.select(F.col("subject").alias("near"), F.col("object").alias("far")).unionByName(now.select(F.col("object").alias("near"), F.col("subject").alias("far")))
    hit = seeds.join(ways, F.col("id") == F.col("near")).where("far <> id")
    base = F.greatest(F.lit(floor), share * F.col("similarity"))
    near = hit.groupBy("query_id", "far").agg(F.max(base).alias("base"))
    return near.join(degrees(triples).withColumnRenamed("id", "far"), "far").select("query_id", F.col("far").alias("id"), (F.col("base") * degree_damping("degree")).alias("score"))


def similar_contexts(edges: DataFrame, seeds: DataFrame, hops: int = 4, decay: float = 0.85, least: float = 1e-4) -> DataFrame:
    """(seed, id, hop, weight): breadth-first over (a, b, confidence), undirected, first visit wins.

    The front carries its weight; a step multiplies by the edge's confidence and by ``decay`` to the power
    of the steps taken before, so k steps are damped by decay^(k(k-1)/2).  Among paths that reach a
    node in the same step, the heaviest counts, ties by the earlier node.
    """
    both = edges.select("a", "b", "confidence").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    both = both.groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"), F.lit(1.0).alias("weight")).distinct()
    front = seen
    for k in range(1, hops + 1):
        step = front.join(both, front["id"] == both["a"]).select("seed", F.col("b").alias("id"), F.lit(k).alias("hop"), (F.col("weight") * F.col("confidence") * decay ** (k - 1)).alias("weight"))
        step = step.where(F.col("weight") >= least).groupBy("seed", "id", "hop").agg(F.max("weight").alias("weight"))
        front = step.join(seen, ["seed", "id"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


#: Similarity by hop.
HOP_SIMILARITY = {1: 0.5, 2: 0.3, 3: 0.1}


def graph_walk(triples: DataFrame, seeds: DataFrame, budget: int = 30) -> DataFrame:
    """(seed, id, hop, score): up to three hops over current facts, not up is_a; the first ``budget`` nodes by hop and id; scores damped by degree.

    A hop takes the first ``budget`` nodes that weren't seen.  At most 1 + 2 * budget were, so the first 1 + 3 * budget
    neighbours of a node decide: a hub is cut to these before it is joined, and before its edges are dealt.
    """
    now = triples.where(is_current(empty_too=True))
    ways = now.where("predicate <> 'is_a'").select(F.col("subject").alias("near"), F.col("object").alias("far"))
    ways = ways.unionByName(now.select(F.col("object").alias("near"), F.col("subject").alias("far"))).distinct()
    first = Window.partitionBy("near").orderBy("far")
    ways = ways.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= 1 + len(HOP_SIMILARITY) * budget).drop("__k")
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct()
    front = seen
    for k in HOP_SIMILARITY:
        step = front.join(ways, front["id"] == ways["near"]).select("seed", F.col("far").alias("id"), F.lit(k).alias("hop")).distinct()
        step = step.join(seen, ["seed", "id"], "left_anti")
        front = step.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("rank") <= budget).drop("rank")
        seen = seen.unionByName(front)
    by = Window.partitionBy("seed").orderBy("hop", "id")
    found = seen.where("hop > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= budget)
    similarity = F.element_at(F.create_map(*(F.lit(x) for kv in HOP_SIMILARITY.items() for x in kv)), F.col("hop"))
    return found.join(degrees(triples), "id").select("seed", "id", "hop", (similarity * degree_damping("degree")).alias("score"))
