"""Queries of pages, status, rooms, contexts behind hits, templates and missing views, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import feedback, rendering, vector
from tessera.plans.fixtures import view, with_views
from tessera.plans.rank_queries import _RATED, _near

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


@query("SELECT id, name FROM entities WHERE id > 'customer_500' ORDER BY id LIMIT 100")
def kg_entity_page(spark, sf_dir):
    """A page of entities after a key."""
    return rendering.page(view(spark, sf_dir, "entities"), "id", 100, "customer_500").select("id", "name")


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 7 = 0 THEN '(null)' ELSE o_orderstatus END AS verdict, o_orderkey % 100 / 10.0e0 AS score FROM orders)
SELECT verdict, count(*) AS n, round(max(score), 6) AS max_score FROM c GROUP BY verdict""")
def jury_status(spark, sf_dir):
    o = F.col("o_orderkey")
    c = view(spark, sf_dir, "orders").select(F.when(o % 3 != 0, "2024-01-01").alias("processed_ts"), F.when(o % 7 != 0, F.col("o_orderstatus")).alias("verdict"), (o % 100 / 10.0).alias("score"))
    return rendering.author_status(c).withColumn("max_score", F.round("max_score", 6))


_ROOM = ", ".join("(" + " + ".join(f"CAST(contains(t, '{k}') AS INT)" for k in words) + f") AS {r}" for r, words in rendering.ROOM_KEYWORDS.items())


@query(
    f"WITH x AS (SELECT doc_id, lower(substring(text, 1, 3000)) AS t FROM documents UNION ALL SELECT -event_id, lower(text) FROM event_messages), s AS (SELECT doc_id, {_ROOM} FROM x), b AS (SELECT *, greatest({', '.join(rendering.ROOM_KEYWORDS)}) AS best FROM s) SELECT doc_id AS id, CASE WHEN best = 0 THEN 'general' "
    + " ".join(f"WHEN {r} = best THEN '{r}'" for r in rendering.ROOM_KEYWORDS)
    + " END AS room FROM b"
)
def fn_room_of_text(spark, sf_dir):
    """Rooms of documents, and of messages under negative ids."""
    both = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(view(spark, sf_dir, "event_messages").select((-F.col("event_id")).alias("id"), "text"))
    return both.select("id", rendering.room_of("text").alias("room"))


@query("""
WITH c AS (SELECT DISTINCT concat('customer_', o_custkey) AS f, o_orderstatus AS t FROM orders WHERE o_custkey % 3 = 0), s AS (SELECT concat('customer_', o_custkey) AS f, o_orderstatus AS t, o_orderkey AS ctx, o_orderdate AS ts FROM orders),
r AS (SELECT s.*, row_number() OVER (PARTITION BY f, t ORDER BY ts DESC, ctx) AS k FROM s), x AS (SELECT f, t, array_to_string(list(concat('- queries=[q', ctx, ', and] keywords=[k', ctx % 9, ', a, b, c, d]') ORDER BY k), chr(10)) AS shared FROM r WHERE k <= 5 AND ctx % 4 <> 0 GROUP BY f, t)
SELECT c.f AS from_entity, c.t AS to_entity, coalesce(shared, '(no shared context metadata available)') AS shared FROM c LEFT JOIN x ON x.f = c.f AND x.t = c.t""")
def jury_shared_contexts(spark, sf_dir):
    """Orders as contexts that a customer and a status share."""
    o = view(spark, sf_dir, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("from_entity"), F.col("o_orderstatus").alias("to_entity"), F.col("o_orderkey").alias("ctx_id"), F.col("o_orderdate").alias("contributed_ts"), "o_custkey")
    k = F.col("ctx_id")
    words = F.array(F.concat(F.lit("k"), k % 9), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"))
    contexts = o.where("ctx_id % 4 <> 0").select("ctx_id", F.array(F.concat(F.lit("q"), k), F.lit("and"), F.lit("more")).alias("queries"), words.alias("keywords"))
    return rendering.shared_contexts(o.where("o_custkey % 3 = 0"), o.drop("o_custkey"), contexts)


@query(f"""WITH {_RATED} SELECT query_id, context_id, concat('ask ', context_id) AS queries, round(max(near.weight), 4) AS link_score FROM x JOIN near USING (query_id, context_id) WHERE context_id <> query_id GROUP BY query_id, context_id""")
def fb_similar_contexts(spark, sf_dir):
    """The contexts that speak for the hits of each context."""
    r = feedback.record_feedback(view(spark, sf_dir, "ratings").withColumn("memory_id", F.col("seq").cast("string")))
    r = r.withColumn("memory_id", F.concat(F.lit("m_"), F.col("memory_id").cast("long") % 40))
    near = _near(spark, sf_dir)
    s = feedback.neighbourhood_scores(near, r)
    contexts = near.select("context_id").distinct().select("context_id", F.array(F.concat(F.lit("ask "), "context_id")).alias("queries"), F.array().cast("array<string>").alias("keywords"))
    told = rendering.similar_contexts(s.select("query_id", "id"), s, near, contexts)[1]
    return told.select("query_id", "context_id", F.array_join("queries", ";").alias("queries"), "link_score")


@query("""SELECT concat('part_', p_partkey) AS template_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE p_type END AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS summary, CASE WHEN p_partkey % 3 = 2 THEN concat('all of ', p_partkey) ELSE '' END AS full_content, concat('op_', p_size) AS op FROM part""")
def kg_hydrated_templates(spark, sf_dir):
    k = F.col("p_partkey")
    p = view(spark, sf_dir, "part")
    props = F.when(k % 3 == 2, F.to_json(F.struct(F.col("p_type").alias("title"), F.concat(F.lit("all of "), k).alias("full_content")))).otherwise('{"title":""}')
    records = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("part_"), k).alias("id"), F.col("p_name").alias("content"), props.alias("properties"))
    t = rendering.hydrated_templates(p.select(F.concat(F.lit("part_"), k).alias("template_id"), F.concat(F.lit("op_"), "p_size").alias("op_id")), records)
    return t.select("template_id", "title", "summary", "full_content", F.col("op_ids")[0].alias("op"))


@query("SELECT doc_id AS id, 64 AS dims FROM documents WHERE doc_id % 5 <> 0 AND trim(coalesce(text, '')) <> ''")
def vec_missing_vectors(spark, sf_dir):
    """Documents without a vector, embedded."""
    d = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    made = rendering.missing_vectors(d, d.where("id % 5 = 0"), vector.hashing_embedder(64))
    return made.select("id", F.size("embedding").alias("dims"))
