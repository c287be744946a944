"""Queries of the knowledge-graph reads, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import degree_damping
from tessera.operators import kg
from tessera.plans.fixtures import view, with_views
from tessera.schemas import SKIP_PREDICATES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


_BOTH = """
SELECT p.entity, p.as_of, 'outgoing' AS direction, t.id AS triple_id, t.predicate, e.name AS other, t.valid_from, t.valid_to, t.confidence, t.valid_to IS NULL AS current
FROM probes AS p JOIN triples AS t ON t.subject = p.entity JOIN entities AS e ON t.object = e.id
WHERE (t.valid_from IS NULL OR t.valid_from <= p.as_of) AND (t.valid_to IS NULL OR t.valid_to >= p.as_of)
UNION ALL
SELECT p.entity, p.as_of, 'incoming', t.id, t.predicate, e.name, t.valid_from, t.valid_to, t.confidence, t.valid_to IS NULL
FROM probes AS p JOIN triples AS t ON t.object = p.entity JOIN entities AS e ON t.subject = e.id
WHERE (t.valid_from IS NULL OR t.valid_from <= p.as_of) AND (t.valid_to IS NULL OR t.valid_to >= p.as_of)"""


@query("WITH probes AS (SELECT concat('customer_', c_custkey) AS entity, '1998-01-01' AS as_of FROM customer)" + _BOTH)
def kg_query_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = view(spark, sf_dir, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("entity"), F.lit("1998-01-01").alias("as_of"))
    return kg.query_entity(probes, view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"))


@query(
    "WITH probes AS (SELECT concat('supplier_', s_suppkey) AS entity, concat('199', 2 + s_suppkey % 6, '-06-15') AS as_of FROM supplier)" + _BOTH
)
def kg_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with a date of their own each."""
    key = F.col("s_suppkey")
    probes = view(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier_"), key).alias("entity"), F.concat(F.lit("199"), (2 + key % 6).cast("string"), F.lit("-06-15")).alias("as_of")
    )
    return kg.query_entity(probes, view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"))


@query("""
SELECT t.id AS triple_id, s.name AS subject_name, t.predicate, o.name AS object_name, t.valid_from, t.valid_to, t.valid_to IS NULL AS current
FROM triples AS t JOIN entities AS s ON t.subject = s.id JOIN entities AS o ON t.object = o.id
WHERE t.predicate = 'placed_by' AND (t.valid_from IS NULL OR t.valid_from <= '1996-07-01') AND (t.valid_to IS NULL OR t.valid_to >= '1996-07-01')""")
def kg_query_relationship(spark, sf_dir):
    return kg.query_relationship(view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"), "placed_by", "1996-07-01")


@query("""
SELECT t.id AS triple_id, s.name AS subject_name, t.predicate, o.name AS object_name, t.valid_from, t.valid_to, t.valid_to IS NULL AS current
FROM triples AS t JOIN entities AS s ON t.subject = s.id JOIN entities AS o ON t.object = o.id
ORDER BY t.valid_from ASC NULLS LAST, t.id LIMIT 100""")
def kg_timeline(spark, sf_dir):
    return kg.timeline(view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"))


@query("""
SELECT (SELECT count(*) FROM entities) AS entities, count(*) AS triples, count(*) FILTER (WHERE valid_to IS NULL) AS current_facts,
       count(*) FILTER (WHERE valid_to IS NOT NULL) AS expired_facts, (SELECT string_agg(predicate, ',' ORDER BY predicate) FROM (SELECT DISTINCT predicate FROM triples) AS p) AS predicates
FROM triples""")
def kg_stats(spark, sf_dir):
    return kg.stats(view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"))


_DEGREES = """
SELECT id, count(*) AS degree FROM (
  SELECT subject AS id FROM triples WHERE valid_to IS NULL OR valid_to = '' UNION ALL SELECT object FROM triples WHERE valid_to IS NULL OR valid_to = ''
) AS ends GROUP BY id"""


@query(_DEGREES)
def kg_entity_degree(spark, sf_dir):
    return kg.degrees(view(spark, sf_dir, "triples"))


@query("""
SELECT id, count(*) AS edges FROM (
  SELECT subject AS id FROM triples WHERE valid_to IS NULL UNION ALL SELECT object FROM triples WHERE valid_to IS NULL AND object <> subject
) AS ends GROUP BY id""")
def kg_edge_count(spark, sf_dir):
    return kg.edge_counts(view(spark, sf_dir, "triples"))


@query("SELECT id, name, kind, importance, last_touched, status FROM entities WHERE status = 'active' AND kind = 'entity'")
def kg_list_entities(spark, sf_dir):
    return kg.list_entities(view(spark, sf_dir, "entities"), kind="entity")


@query("SELECT id, name, kind, importance, last_touched, status FROM entities WHERE status = 'active' AND id IN (SELECT concat('customer_', o_custkey) FROM orders)")
def kg_get_entity(spark, sf_dir):
    ids = view(spark, sf_dir, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("id"))
    return kg.get_entities(ids, view(spark, sf_dir, "entities"))


@query("SELECT t.id, coalesce(a.canonical_id, t.who) AS who FROM (SELECT o_orderkey AS id, concat('cust_', o_custkey) AS who FROM orders) AS t LEFT JOIN aliases AS a ON a.alias = t.who")
def kg_alias_resolution(spark, sf_dir):
    rows = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("cust_"), "o_custkey").alias("who"))
    return kg.resolve_aliases(rows, "who", view(spark, sf_dir, "aliases"))


@query(f"""
SELECT id, subject, predicate, object FROM triples WHERE statement IS NULL AND predicate NOT IN ({", ".join(f"'{p}'" for p in SKIP_PREDICATES)}) ORDER BY id LIMIT 50""")
def kg_unverbalised(spark, sf_dir):
    return kg.unverbalised(view(spark, sf_dir, "triples"), 50).select("id", "subject", "predicate", "object")


@query("SELECT id, subject, predicate, object FROM triples WHERE creation_context_id = 'ctx_7' AND (valid_to IS NULL OR valid_to = '')")
def kg_created_under(spark, sf_dir):
    return kg.created_under(view(spark, sf_dir, "triples"), "ctx_7").select("id", "subject", "predicate", "object")


_UP = """
WITH RECURSIVE up AS (SELECT subject, object FROM triples WHERE predicate IN ('is_a', 'located_in') AND valid_to IS NULL),
walk AS (
  SELECT id, id AS ancestor, 0 AS depth FROM entities WHERE kind = 'entity'
  UNION SELECT w.id, u.object, w.depth + 1 FROM walk AS w JOIN up AS u ON u.subject = w.ancestor WHERE w.depth < 5
), least AS (SELECT id, ancestor, min(depth) AS depth FROM walk GROUP BY id, ancestor)"""


def _hierarchy(spark, sf_dir):
    t = view(spark, sf_dir, "triples").where("predicate IN ('is_a', 'located_in')").withColumn("predicate", F.lit("is_a"))
    return t, view(spark, sf_dir, "entities").where("kind = 'entity'").select("id")


@query(_UP + " SELECT id, ancestor, depth FROM least")
def kg_closure(spark, sf_dir):
    return kg.closure(*_hierarchy(spark, sf_dir))


@query(_UP + " SELECT DISTINCT id FROM least WHERE ancestor IN ('region_1', 'region_3')")
def kg_is_subclass_of(spark, sf_dir):
    t, seeds = _hierarchy(spark, sf_dir)
    allowed = view(spark, sf_dir, "region").where("r_regionkey IN (1, 3)").select(F.concat(F.lit("region_"), "r_regionkey").alias("id"))
    return kg.is_subclass_of(t, seeds, allowed)


@query("""
WITH now AS (SELECT * FROM triples WHERE valid_to IS NULL AND predicate IN ('placed_by', 'located_in')),
n AS (SELECT id, subject, predicate, object, count(*) OVER (PARTITION BY subject, predicate) AS per_subject, count(*) OVER (PARTITION BY object, predicate) AS per_object FROM now)
SELECT id AS triple_id, subject, predicate, object, per_subject, per_object FROM n
WHERE (predicate = 'placed_by' AND (per_subject > 1 OR per_object > 1)) OR (predicate = 'located_in' AND per_subject > 1)""")
def kg_cardinality(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES ('placed_by', 'one-to-one'), ('located_in', 'many-to-one') AS t(predicate, cardinality)")
    return kg.cardinality_violations(view(spark, sf_dir, "triples"), rules)


_MOVED = "SELECT concat('n_', c_custkey) AS id, concat('customer_', c_custkey) AS subject, 'located_in' AS predicate, concat('nation_', c_custkey % 25) AS object FROM customer"


@query(f"""
WITH fresh AS ({_MOVED})
SELECT f.id AS new_id, f.subject, f.predicate, f.object, t.id AS existing_id, t.object AS existing_object FROM fresh AS f JOIN triples AS t ON t.subject = f.subject AND t.predicate = f.predicate
WHERE t.valid_to IS NULL AND t.object <> f.object AND t.predicate <> 'is_a'""")
def kg_contradictions(spark, sf_dir):
    view(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return kg.contradictions(spark.sql(_MOVED), view(spark, sf_dir, "triples"))


@query("""
SELECT t.id AS triple_id, t.predicate, s.kind AS subject_kind, o.kind AS object_kind FROM triples AS t JOIN entities AS s ON t.subject = s.id JOIN entities AS o ON t.object = o.id
WHERE (t.predicate = 'supplies' AND o.kind NOT IN ('entity', 'record')) OR (t.predicate = 'is_a' AND o.kind NOT IN ('class'))""")
def kg_kind_constraints(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES ('supplies', array('entity'), array('entity', 'record')), ('is_a', array(), array('class')) AS t(predicate, subject_kinds, object_kinds)")
    return kg.kind_violations(view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"), rules)


@query("""
WITH ends AS (SELECT id, subject AS missing FROM triples UNION ALL SELECT id, object FROM triples)
SELECT e.id AS triple_id, e.missing FROM ends AS e WHERE NOT EXISTS (SELECT 1 FROM entities AS x WHERE x.id = e.missing AND x.status = 'active')""")
def kg_phantom_check(spark, sf_dir):
    return kg.missing_endpoints(view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities"))


@query("""
WITH a AS (SELECT DISTINCT concat('customer_', o_custkey) AS id FROM orders), b AS (SELECT concat('customer_', c_custkey) AS id FROM customer)
SELECT id, 'left_only' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'right_only' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def kg_orphans(spark, sf_dir):
    a = view(spark, sf_dir, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("id")).distinct()
    return kg.orphans(a, view(spark, sf_dir, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("id")))


@query(f"""
WITH degree AS ({_DEGREES}), now AS (SELECT subject, object FROM triples WHERE valid_to IS NULL OR valid_to = ''),
ways AS (SELECT subject AS near, object AS far FROM now UNION ALL SELECT object, subject FROM now),
seeds AS (SELECT concat('q', n_regionkey) AS query_id, concat('nation_', n_nationkey) AS id, n_nationkey / 25.0e0 AS similarity FROM nation),
hit AS (SELECT query_id, far, max(greatest(0.2e0, 0.8e0 * similarity)) AS base FROM seeds JOIN ways ON id = near WHERE far <> id GROUP BY query_id, far)
SELECT h.query_id, h.far AS id, round(h.base / ln(d.degree + 2), 6) AS score FROM hit AS h JOIN degree AS d ON d.id = h.far""")
def kg_graph_channel(spark, sf_dir):
    seeds = view(spark, sf_dir, "nation").select(
        F.concat(F.lit("q"), "n_regionkey").alias("query_id"), F.concat(F.lit("nation_"), "n_nationkey").alias("id"), (F.col("n_nationkey") / 25.0).alias("similarity")
    )
    return kg.graph_channel(seeds, view(spark, sf_dir, "triples")).withColumn("score", F.round("score", 6))


@query("""
SELECT id AS triple_id, coalesce(nullif(trim(statement), ''), concat(subject, ' ', replace(predicate, '_', ' '), ' ', object, '.')) AS statement_text FROM triples""")
def kg_statement_text(spark, sf_dir):
    return view(spark, sf_dir, "triples").select(F.col("id").alias("triple_id"), kg.statement_text().alias("statement_text"))


@query("SELECT a.id, round(1.0e0 / ln(a.degree + 2), 6) AS damping FROM (" + _DEGREES + ") AS a")
def fn_degree_damping(spark, sf_dir):
    return kg.degrees(view(spark, sf_dir, "triples")).select("id", F.round(degree_damping("degree"), 6).alias("damping"))


@query("""
WITH RECURSIVE now AS (SELECT subject, predicate, object FROM triples WHERE valid_to IS NULL OR valid_to = ''),
ways AS (SELECT subject AS near, object AS far FROM now WHERE predicate <> 'is_a' UNION SELECT object, subject FROM now),
h1 AS (SELECT concat('supplier_', s_suppkey) AS seed, w.far AS id FROM supplier JOIN ways AS w ON w.near = concat('supplier_', s_suppkey) WHERE w.far <> concat('supplier_', s_suppkey)),
f1 AS (SELECT seed, id FROM (SELECT DISTINCT seed, id, dense_rank() OVER (PARTITION BY seed ORDER BY id) AS r FROM h1) AS x WHERE r <= 30),
h2 AS (SELECT DISTINCT f.seed, w.far AS id FROM f1 AS f JOIN ways AS w ON w.near = f.id WHERE w.far <> f.seed AND NOT EXISTS (SELECT 1 FROM f1 AS s WHERE s.seed = f.seed AND s.id = w.far)),
f2 AS (SELECT seed, id FROM (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS r FROM h2) AS x WHERE r <= 30),
h3 AS (SELECT DISTINCT f.seed, w.far AS id FROM f2 AS f JOIN ways AS w ON w.near = f.id WHERE w.far <> f.seed AND NOT EXISTS (SELECT 1 FROM f1 AS s WHERE s.seed = f.seed AND s.id = w.far) AND NOT EXISTS (SELECT 1 FROM f2 AS s WHERE s.seed = f.seed AND s.id = w.far)),
allh AS (SELECT seed, id, 1 AS hop FROM f1 UNION ALL SELECT seed, id, 2 FROM f2 UNION ALL SELECT seed, id, 3 FROM h3),
pick AS (SELECT seed, id, hop, row_number() OVER (PARTITION BY seed ORDER BY hop, id) AS r FROM allh),
degree AS (SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM now UNION ALL SELECT object FROM now) AS e GROUP BY id)
SELECT p.seed, p.id, p.hop, round(CASE p.hop WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.3e0 ELSE 0.1e0 END / ln(d.degree + 2), 6) AS score FROM pick AS p JOIN degree AS d ON d.id = p.id WHERE p.r <= 30""")
def kg_graph_walk(spark, sf_dir):
    seeds = view(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("id"))
    return kg.graph_walk(view(spark, sf_dir, "triples"), seeds).withColumn("score", F.round("score", 6))


_SIM = "SELECT concat('nation_', n_nationkey) AS a, concat('nation_', (n_nationkey * 3 + 1) % 25) AS b, round(0.65e0 + n_nationkey % 4 / 10.0e0, 2) AS confidence FROM nation"
_HOP = "SELECT f.seed, w.b AS id, max(round(f.weight * w.confidence * {d}, 12)) AS weight FROM {f} AS f JOIN w ON w.a = f.id WHERE round(f.weight * w.confidence * {d}, 12) >= 0.0001 {seen} GROUP BY f.seed, w.b"


def _seen(k: int) -> str:
    return "AND w.b <> f.seed " + " ".join(f"AND NOT EXISTS (SELECT 1 FROM h{i} AS s WHERE s.seed = f.seed AND s.id = w.b)" for i in range(1, k))


@query(
    f"WITH e AS ({_SIM}), u AS (SELECT a, b, confidence FROM e UNION ALL SELECT b, a, confidence FROM e), w AS (SELECT a, b, max(confidence) AS confidence FROM u GROUP BY a, b), h0 AS (SELECT concat('nation_', n_nationkey) AS seed, concat('nation_', n_nationkey) AS id, 1.0e0 AS weight FROM nation), "
    + ", ".join(f"h{k} AS ({_HOP.format(d=f'{0.85 ** (k - 1)!r}e0', f=f'h{k - 1}', seen=_seen(k))})" for k in range(1, 5))
    + " "
    + " UNION ALL ".join(f"SELECT seed, id, {k} AS hop, round(weight, 6) AS weight FROM h{k}" for k in range(1, 5))
)
def kg_similar_contexts(spark, sf_dir):
    view(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    seeds = view(spark, sf_dir, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"))
    return kg.similar_contexts(spark.sql(_SIM), seeds).withColumn("weight", F.round("weight", 6))


@query("""
WITH kinds AS (SELECT DISTINCT s.kind AS a_kind, o.kind AS b_kind FROM triples AS t JOIN entities AS s ON t.subject = s.id JOIN entities AS o ON t.object = o.id),
p AS (SELECT 'supplies' AS predicate, ['entity'] AS s, ['literal'] AS o UNION ALL SELECT 'placed_by', ['record'], ['entity'] UNION ALL SELECT 'near', [], [] UNION ALL SELECT 'is_a', [], ['class']),
x AS (SELECT a_kind, b_kind, predicate, row_number() OVER (PARTITION BY a_kind, b_kind ORDER BY predicate) AS rank FROM kinds, p WHERE (len(s) = 0 OR list_contains(s, a_kind)) AND (len(o) = 0 OR list_contains(o, b_kind)))
SELECT a_kind, b_kind, predicate, rank FROM x WHERE rank <= 12""")
def kg_compatible_predicates(spark, sf_dir):
    t, e = view(spark, sf_dir, "triples"), view(spark, sf_dir, "entities")
    pairs = t.join(e.select(F.col("id").alias("subject"), F.col("kind").alias("a_kind")), "subject").join(e.select(F.col("id").alias("object"), F.col("kind").alias("b_kind")), "object")
    rules = spark.sql("SELECT * FROM VALUES ('supplies', array('entity'), array('literal')), ('placed_by', array('record'), array('entity')), ('near', array(), array()), ('is_a', array(), array('class')) AS t(predicate, subject_kinds, object_kinds)")
    return kg.compatible_predicates(pairs, rules)


@query("SELECT subject, count(*) FILTER (WHERE predicate IN ('placed_by')) AS hidden, count(*) FILTER (WHERE predicate NOT IN ('placed_by')) AS shown FROM triples GROUP BY subject")
def kg_hidden_edges(spark, sf_dir):
    t = view(spark, sf_dir, "triples").withColumn("predicate", F.when(F.col("predicate") == "placed_by", "surfaced").otherwise(F.col("predicate")))
    return kg.without_bookkeeping(t, ["subject"])[1]


@query(_UP + """, p AS (SELECT concat('region_', r_regionkey) AS ancestor, concat('slots of ', r_name) AS slots, [concat('tool_', r_regionkey)] AS tools FROM region UNION ALL SELECT concat('nation_', n_nationkey), CASE WHEN n_nationkey % 2 = 0 THEN concat('slots of ', n_name) END, ['base', concat('n', n_nationkey % 3)] FROM nation),
j AS (SELECT l.id, l.depth, l.ancestor, p.slots, p.tools FROM least AS l JOIN p USING (ancestor))
SELECT id, first(slots ORDER BY depth, ancestor) FILTER (WHERE slots IS NOT NULL) AS slots, array_to_string(list_sort(list_distinct(flatten(list(tools)))), ',') AS tools FROM j GROUP BY id""")
def kg_intent_profile(spark, sf_dir):
    t, seeds = _hierarchy(spark, sf_dir)
    r = view(spark, sf_dir, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("id"), F.concat(F.lit("slots of "), "r_name").alias("slots"), F.array(F.concat(F.lit("tool_"), "r_regionkey")).alias("tools"))
    n = view(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("slots of "), "n_name")).alias("slots"),
        F.array(F.lit("base"), F.concat(F.lit("n"), F.col("n_nationkey") % 3)).alias("tools"),
    )
    return kg.resolve_profile(t, r.unionByName(n), seeds).withColumn("tools", F.array_join("tools", ","))
