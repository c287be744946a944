"""Queries of writes, checks and small rules that keep a memory in order, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import halls, scoring
from tessera.functions import text as T
from tessera.operators import entities, keywords, metrics, rankers, services, state
from tessera.plans.fixtures import view, with_views
from tessera.streaming import ops

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# ---- entities ----


@query("""
WITH u AS (SELECT concat('customer_', c_custkey) AS id, c_name AS name, 'kept' AS content, 4 AS importance, 's0' AS session_id, 'merged' AS status, 0 AS o, c_custkey AS ts FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT concat('customer_', o_custkey), concat('order ', o_orderkey), CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('by ', o_orderkey) END, CAST(o_orderkey % 5 + 1 AS INT), CASE WHEN o_orderkey % 3 = 0 THEN concat('s', o_orderkey) END, 'x', 1, o_orderkey FROM orders),
k AS (SELECT *, o * 1000000000 + ts AS k FROM u)
SELECT id, arg_max(name, k) AS name, coalesce(arg_max(content, k) FILTER (WHERE content <> ''), '') AS content, coalesce(arg_max(importance, k) FILTER (WHERE importance <> 3), 3) AS importance, coalesce(arg_min(session_id, k) FILTER (WHERE session_id IS NOT NULL), '') AS session_id, CASE WHEN max(o) = 1 THEN 'active' ELSE arg_max(status, k) END AS status FROM k GROUP BY id""")
def state_upsert_entities(spark, sf_dir):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    now = view(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        _cat("customer_", c).alias("id"), F.col("c_name").alias("name"), F.lit("entity").alias("kind"), F.lit("kept").alias("content"), F.lit(4).alias("importance"), none.alias("properties"), F.lit("s0").alias("session_id"),
        none.alias("intent_id"), F.lit("merged").alias("status"), c.alias("ts"),
    )
    new = view(spark, sf_dir, "orders").select(
        _cat("customer_", F.col("o_custkey")).alias("id"), _cat("order ", o).alias("name"), F.lit("entity").alias("kind"), F.when(o % 2 == 0, "").otherwise(_cat("by ", o)).alias("content"), (o % 5 + 1).cast("int").alias("importance"),
        none.alias("properties"), F.when(o % 3 == 0, _cat("s", o)).alias("session_id"), none.alias("intent_id"), F.lit("x").alias("status"), o.alias("ts"),
    )
    e = state.upsert_entities(now, new)
    return e.select("id", "name", F.coalesce("content", F.lit("")).alias("content"), "importance", F.coalesce("session_id", F.lit("")).alias("session_id"), "status")


@query("SELECT id, CASE WHEN kind = 'entity' AND id IN (SELECT concat('customer_', o_custkey) FROM orders WHERE o_orderkey % 10 = 0) THEN '2025-01-01' ELSE last_touched END AS last_touched FROM entities")
def state_touch(spark, sf_dir):
    used = view(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(_cat("customer_", F.col("o_custkey")).alias("id"))
    return state.touch(view(spark, sf_dir, "entities"), used, "2025-01-01").select("id", "last_touched")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('{\"a\":\"1\",\"b\":\"', p_size, '\",\"c\":\"', p_partkey, '\"}') WHEN 1 THEN '{\"a\":\"1\",\"b\":\"old\"}' ELSE concat('{\"b\":\"', p_size, '\"}') END AS properties FROM part")
def state_merge_properties(spark, sf_dir):
    k = F.col("p_partkey")
    old = F.when(k % 3 != 2, '{"a":1,"b":"old"}')
    new = F.when(k % 3 == 0, _cat('{"b":"', F.col("p_size"), '","c":', k, "}")).when(k % 3 == 2, _cat('{"b":', F.col("p_size"), "}"))
    return view(spark, sf_dir, "part").select(k.alias("id"), old.alias("old"), new.alias("new")).select("id", state.merge_properties("old", "new").alias("properties"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN '{\"current_phase\":\"unknown\",\"active_branches\":[],\"open_todos\":[],\"recent_milestones\":[]}' WHEN 1 THEN '{\"todos\":[]}' WHEN 2 THEN '{\"current_focus\":\"idle\",\"pending_followups\":[],\"recent_findings\":[]}' WHEN 3 THEN '{\"status\":\"pending\",\"subtodos\":[]}' ELSE '{}' END AS payload FROM supplier")
def state_default_payload(spark, sf_dir):
    names = F.array(*map(F.lit, ["project_state", "intent_state", "agent_state", "task_state", "none"]))
    return view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), state.default_payload(F.get(names, (F.col("s_suppkey") % 5).cast("int"))).alias("payload"))


@query("SELECT concat('part_', p_partkey) AS class_id FROM part WHERE p_size % 3 = 0")
def kg_state_classes(spark, sf_dir):
    props = F.to_json(F.struct((F.col("p_size") % 3 == 0).alias("state_updatable"), F.col("p_name").alias("name")))
    return services.state_classes(view(spark, sf_dir, "part").select(_cat("part_", F.col("p_partkey")).alias("id"), props.alias("properties")))


@query("""
WITH bear AS (SELECT concat('region_', r_regionkey) AS c FROM region WHERE r_regionkey < 2), c AS (SELECT concat('nation_', n_nationkey) AS id FROM nation WHERE concat('region_', n_regionkey) IN (SELECT c FROM bear))
SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN concat('state of ', id) ELSE 'none' END AS payload FROM entities WHERE kind = 'entity'""")
def kg_attach_state(spark, sf_dir):
    e = view(spark, sf_dir, "entities").where("kind = 'entity'").select("id")
    bearing = view(spark, sf_dir, "region").where("r_regionkey < 2").select(_cat("region_", F.col("r_regionkey")).alias("class_id"))
    latest = e.select(F.col("id").alias("entity_id"), _cat("state of ", F.col("id")).alias("payload"))
    return services.attach_state(e, view(spark, sf_dir, "triples"), bearing, latest).select("id", F.coalesce("payload", F.lit("none")).alias("payload"))


@query("SELECT c_custkey AS id, replace(c_name, 'Customer', 'Client') AS name, replace(c_mktsegment, 'Customer', 'Client') AS segment FROM customer")
def state_replace_everywhere(spark, sf_dir):
    c = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return state.replace_everywhere(c, "Customer", "Client")


@query("SELECT CAST(label AS VARCHAR) AS source_file, count(*) AS records, count(*) AS kept, CAST(0 AS BIGINT) AS removed FROM embeddings GROUP BY label HAVING count(*) >= 5 UNION ALL SELECT 'total', count(*), count(*), 0 FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 5)")
def dedup_totals(spark, sf_dir):
    """Vectors of which none is near another, by label and in all."""
    from tessera.operators import dedup

    v = view(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("source_file"), F.col("vec_id").alias("id"), F.lit("a text of a fixed length, long enough").alias("text"), "embedding")
    r = dedup.dedup_report(dedup.dedup_sources(v, threshold=0.05))
    return r.withColumn("source_file", F.coalesce("source_file", F.lit("total")))


# ---- queues ----


@query("""WITH q AS (SELECT user_id, count(*) % 5 AS attempted_count, max(CAST(ts AS VARCHAR)) AS last_attempt_ts, user_id % 7 = 0 AS done FROM events GROUP BY user_id)
SELECT concat('m', user_id) AS memory_key, attempted_count FROM q WHERE attempted_count < 3 AND NOT done ORDER BY attempted_count, last_attempt_ts DESC, concat('m', user_id) LIMIT 25""")
def queue_pending_flags(spark, sf_dir):
    q = view(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") % 5).alias("attempted_count"), F.max(F.col("ts").cast("string")).alias("last_attempt_ts"))
    q = q.select(_cat("m", F.col("user_id")).alias("memory_key"), "attempted_count", "last_attempt_ts", F.when(F.col("user_id") % 7 == 0, "merged").alias("resolution"))
    return state.pending_flags(q, 25).select("memory_key", "attempted_count")


@query("SELECT concat('customer_', o_custkey) AS from_entity, o_orderstatus AS to_entity, round(count(*) * 0.5e0, 6) AS score FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) >= 3 AND o_custkey % 4 <> 0 ORDER BY count(*) DESC, concat('customer_', o_custkey), o_orderstatus LIMIT 30")
def queue_pending_candidates(spark, sf_dir):
    c = view(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg((F.count("*") * 0.5).alias("score"))
    c = c.select(_cat("customer_", F.col("o_custkey")).alias("from_entity"), F.col("o_orderstatus").alias("to_entity"), "score", F.when(F.col("o_custkey") % 4 == 0, "2024-01-01").alias("processed_ts"))
    return state.pending_candidates(c, 30).select("from_entity", "to_entity", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT c_nationkey AS pair_id, concat('ctx', o_custkey % 60) AS context_id FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), x AS (SELECT *, CAST(substring(context_id, 4) AS INT) AS n FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n % 17 DESC, context_id) AS rank FROM x)
SELECT pair_id, array_to_string((list(concat('q', n) ORDER BY rank))[:2], ',') AS queries, array_to_string(list_slice(list_distinct_in_order, 1, 5), ',') AS keywords FROM (SELECT pair_id, n, rank, list_reduce(list_transform(list(concat('k', n % 5)) OVER (PARTITION BY pair_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), lambda w: [w]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_in_order FROM r WHERE rank <= 5) AS y GROUP BY pair_id, list_distinct_in_order""")
def jury_domain_hint(spark, sf_dir):
    """Nations as pairs, contexts by number."""
    c = view(spark, sf_dir, "orders").join(view(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = c.select(F.col("c_nationkey").alias("pair_id"), _cat("ctx", F.col("o_custkey") % 60).alias("context_id")).distinct()
    n = F.col("n")
    contexts = p.select("context_id").distinct().withColumn("n", F.substring("context_id", 4, 9).cast("int")).select("context_id", (n % 17).alias("ts"), F.array(_cat("q", n)).alias("queries"), F.array(_cat("k", n % 5)).alias("keywords"))
    h = services.domain_hint(p, contexts)
    return h.select("pair_id", F.array_join("queries", ",").alias("queries"), F.array_join("keywords", ",").alias("keywords"))


@query("SELECT concat('customer_', o_custkey) AS subject, CASE o_orderstatus WHEN 'F' THEN 'bought' ELSE 'ordered' END AS predicate, concat('order_', o_orderkey) AS object, 0.9e0 AS confidence FROM orders WHERE o_orderstatus IN ('F', 'O')")
def jury_accepted_edges(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "edge:bought").when(F.col("o_orderstatus") == "O", "edge:ordered").otherwise("uncertain")
    j = view(spark, sf_dir, "orders").select(_cat("customer_", F.col("o_custkey")).alias("from_entity"), _cat("order_", F.col("o_orderkey")).alias("to_entity"), verdict.alias("verdict"))
    return services.persist_verdicts(j)[1]


@query("SELECT context_id, seq AS id, relevance = 1 OR (seq % 3 = 0 AND seq % 10 >= 7) AS weak FROM ratings")
def fb_weak_reasons(spark, sf_dir):
    r = view(spark, sf_dir, "ratings").select("context_id", F.col("seq").alias("id"), F.when(F.col("relevance") == 1, "No Reason given").otherwise("it helped").alias("reason"))
    near = r.where("id % 3 = 0").select("id", (F.col("id") % 10 / 10.0).alias("similarity"))
    return services.weak_reasons(r, [r"^no reason\b", r"^n/a$"], near).select("context_id", "id", "weak")


@query("""SELECT concat('init_nation_', n_nationkey) AS rev_id, concat('nation_', n_nationkey) AS entity_id, CASE WHEN n_nationkey % 2 = 0 THEN 'intent_state' ELSE 'task_state' END AS schema_id, CASE WHEN n_nationkey % 2 = 0 THEN '{"todos":[]}' ELSE '{"status":"pending","subtodos":[]}' END AS payload, '2024-02-01' AS created_at, 2 AS schema_version FROM nation WHERE n_nationkey % 3 <> 0""")
def state_initial_revisions(spark, sf_dir):
    n, k = view(spark, sf_dir, "nation"), F.col("n_nationkey")
    own = n.select(_cat("nation_", k).alias("entity_id"), F.when(k % 2 == 0, "intent_state").otherwise("task_state").alias("schema_id"))
    return state.initial_revisions(own.unionByName(own), n.where("n_nationkey % 3 = 0").select(_cat("nation_", k).alias("entity_id")), "2024-02-01")


@query("WITH q AS (SELECT user_id, count(*) % 5 AS a FROM events GROUP BY user_id) SELECT count(*) FILTER (WHERE a < 3 AND user_id % 7 <> 0) AS pending, count(*) FILTER (WHERE a >= 3 AND user_id % 7 <> 0) AS frozen FROM q")
def queue_pending_count(spark, sf_dir):
    q = view(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") % 5).alias("attempted_count"))
    return state.pending_count(q.withColumn("resolution", F.when(F.col("user_id") % 7 == 0, "merged")))


@query("""WITH l AS (SELECT user_id, max(ts) AS last_run FROM events WHERE event_type = 'purchase' GROUP BY user_id), n AS (SELECT user_id, count(*) AS pending FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id AS agent, pending FROM n LEFT JOIN l USING (user_id) WHERE last_run IS NULL OR last_run <= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 12 HOUR""")
def queue_due_agents(spark, sf_dir):
    """Purchases as runs, errors as what waits."""
    e = view(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("ts").cast("timestamp").alias("started_ts"), "event_type")
    return state.due(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), "2024-01-25", "12 hours", 3).select("agent", "pending")


# ---- views and contexts ----


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0")
def views_missing_summary(spark, sf_dir):
    k = F.col("p_partkey")
    e = view(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("summary"))
    v = view(spark, sf_dir, "part").where("p_partkey % 3 <> 1").select(k.alias("owner_id"), (k % 3 == 0).alias("is_summary_view"))
    return services.missing_summary_views(e, v).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN concat('ask ', c_custkey) ELSE concat('ask ', c_custkey, ';', c_name) END AS queries FROM customer")
def views_without_pollution(spark, sf_dir):
    k = F.col("c_custkey")
    c = view(spark, sf_dir, "customer").select(k.alias("id"), F.array(_cat("ask ", k), F.col("c_name"), _cat("intent_", k)).alias("queries"))
    linked = view(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(k.alias("context_id"), F.col("c_name").alias("content"))
    return services.without_pollution(c, linked).select("id", F.array_join("queries", ";").alias("queries"))


@query("SELECT vec_id AS a, vec_id + 1 AS b, round(vec_id % 100 / 100.0e0, 6) AS confidence, CASE WHEN vec_id % 100 >= 65 THEN 'kept' ELSE 'closed' END AS fate FROM embeddings WHERE vec_id % 3 <> 0")
def views_similar_edges(spark, sf_dir):
    k = F.col("vec_id")
    v = view(spark, sf_dir, "embeddings")
    kept, closed = services.similar_edges(v.select(k.alias("a"), (k + 1).alias("b"), F.lit(1.0).alias("confidence")), v.where("vec_id % 3 <> 0").select(k.alias("a"), (k + 1).alias("b"), F.round(k % 100 / 100.0, 6).alias("similarity")), 0.65, "2024-01-01")
    return kept.select("a", "b", "confidence", F.lit("kept").alias("fate")).unionByName(closed.select("a", "b", "confidence", F.lit("closed").alias("fate")))


@query("""WITH t AS (SELECT doc_id % 40 AS k, doc_id, substring(text, 1, 500) AS s FROM documents WHERE doc_id % 40 < 20)
SELECT concat('agent', k) AS agent, array_to_string(list(s ORDER BY concat('doc_', doc_id)), chr(10)) AS identity FROM t GROUP BY k""")
def layer_identity(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    doc, agent = _cat("doc_", F.col("doc_id")), _cat("agent", F.col("doc_id") % 40)
    t = d.select(agent.alias("subject"), F.lit("described_by").alias("predicate"), doc.alias("object"), F.lit(None).cast("string").alias("valid_to"))
    return services.layer_zero(d.where("doc_id % 40 < 20").select(agent.alias("agent")).distinct(), t, d.select(doc.alias("id"), "text"))


# ---- keywords ----

_POSTS = "SELECT concat('customer_', o_custkey) AS entity_id, o_orderstatus AS keyword, o_orderpriority AS source, o_orderkey AS added_at FROM orders"


@query(f"SELECT entity_id, keyword, arg_max(source, added_at) AS source, max(added_at) AS added_at FROM ({_POSTS}) AS p GROUP BY entity_id, keyword")
def kw_add_keywords(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return keywords.add_keywords(p.where("added_at % 2 = 0"), p.where("added_at % 2 = 1"))


def _posts(spark, sf_dir):
    return view(spark, sf_dir, "orders").select(_cat("customer_", F.col("o_custkey")).alias("entity_id"), F.col("o_orderstatus").alias("keyword"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("added_at"))


@query(f"SELECT entity_id, keyword, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY at, keyword) AS INT) AS position FROM (SELECT entity_id, keyword, max(added_at) AS at FROM ({_POSTS}) AS p GROUP BY entity_id, keyword) AS x".replace(" at,", " latest,").replace("AS at FROM", "AS latest FROM"))
def kw_entity_keywords(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return keywords.entity_keywords(keywords.add_keywords(p, p.where("false")))


@query("SELECT o_orderstatus AS keyword, count(DISTINCT o_custkey) AS freq FROM orders GROUP BY o_orderstatus")
def kw_observations(spark, sf_dir):
    return keywords.count_observations(view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderstatus").alias("keyword")))


@query("SELECT event_type AS keyword, count(*) AS freq FROM events GROUP BY event_type")
def stream_keyword_counts(spark, sf_dir):
    return ops.keyword_counts(view(spark, sf_dir, "events").select(F.col("event_type").alias("keyword")))


@query("SELECT event_id AS id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def stream_error_ring(spark, sf_dir):
    return ops.error_ring(view(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), "ts"))


# ---- metrics and rankers ----


@query("""WITH l AS (SELECT l_orderkey AS q, l_linenumber AS rank, CAST(l_quantity > 25 AS INT) AS label FROM lineitem), u AS (SELECT q, rank, max(label) AS label FROM l GROUP BY q, rank), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY label DESC, rank) AS ideal FROM u WHERE rank <= 5)
SELECT q, round(CASE WHEN sum(label / log2(ideal + 1)) > 0 THEN sum(label / log2(rank + 1)) / sum(label / log2(ideal + 1)) ELSE 0 END, 9) AS ndcg FROM t GROUP BY q""")
def metric_binary_ndcg(spark, sf_dir):
    r = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("rank")).agg(F.max((F.col("l_quantity") > 25).cast("int")).alias("label"))
    return metrics.binary_ndcg(r, ["q"], 5).select("q", F.round("ndcg", 9).alias("ndcg"))


@query("SELECT o_orderkey AS query_id, o_orderkey % 10 IN (o_custkey % 10, o_custkey % 7) OR o_orderkey % 10 IN (o_custkey % 3, 9) AS hit FROM orders")
def metric_target_hit(spark, sf_dir):
    c = F.col("o_custkey")
    r = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.array(F.col("o_orderkey") % 10).alias("targets"), F.array(c % 10, c % 7).alias("sids"), F.array(c % 3, F.lit(9).cast("long")).alias("globals"))
    return rankers.target_hit(r)


@query("""WITH x AS (SELECT event_id, event_id % 100 / 100.0e0 AS d, user_id % 10 / 10.0e0 AS o, CAST(event_id % 3 = 0 AS INT) * 1.0e0 AS q, CAST(event_id % 4 = 0 AS INT) * 0.5e0 AS n, event_id % 5 AS h FROM events)
SELECT event_id, round(d * (1 - 0.5e0 * o) * (1 - 0.6e0 * q) * (1 - 0.2e0 * n), 9) AS rooms, round(d * CASE h WHEN 0 THEN 0.75e0 WHEN 1 THEN 0.9e0 ELSE 1 END * CASE WHEN event_id % 2 = 0 THEN 0.85e0 ELSE 1 END * (1 - 0.1e0 * q), 9) AS hall, round(d * CASE WHEN h = 2 THEN 0.8e0 ELSE 1 END, 9) AS room FROM x""")
def rank_room_scores(spark, sf_dir):
    k, h = F.col("event_id"), F.col("event_id") % 5
    e = view(spark, sf_dir, "events").withColumn("d", k % 100 / 100.0)
    q = (k % 3 == 0).cast("double")
    rooms = rankers.rooms_score("d", F.col("user_id") % 10 / 10.0, q, (k % 4 == 0).cast("double") * 0.5)
    hall = rankers.hall_score("d", h, F.lit(0), F.lit(1), k % 2 == 0, 0.1 * q)
    return e.select("event_id", F.round(rooms, 9).alias("rooms"), F.round(hall, 9).alias("hall"), F.round(rankers.room_score("d", h, F.lit(2)), 9).alias("room"))


@query("SELECT conv_id, turn, concat_ws(' ', concat('[', turn, ']'), CASE WHEN role = 'user' THEN concat('[User] ', text) END, CASE WHEN role = 'assistant' THEN concat('[Assistant] ', text) END) AS text FROM conversations WHERE text <> ''")
def fn_turn_text(spark, sf_dir):
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    return view(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", rankers.turn_text(F.col("turn").cast("string"), said("user"), said("assistant")).alias("text"))


# ---- functions ----


@query("SELECT o_orderkey AS id, round((o_orderkey % 3 - 1 + 1) / 2.0e0, 6) AS rel, round((o_orderkey % 5) / 4.0e0, 6) AS imp, round(1.0e0 / (1 + o_custkey / 30.0e0), 6) AS decay FROM orders")
def fn_learning_features(spark, sf_dir):
    o = F.col("o_orderkey")
    f = view(spark, sf_dir, "orders").select(o.alias("id"), scoring.learning_features(o % 3 - 1, o % 5 + 1, F.col("o_custkey")).alias("f"))
    return f.select("id", *(F.round(F.col(f"f.{c}"), 6).alias(c) for c in ("rel", "imp", "decay")))


@query("""WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'abc' ELSE concat(p_name, ' cafe') END AS w, concat('because of Strasse ', p_type) AS y, CASE WHEN p_partkey % 6 = 0 THEN 'some' ELSE '' END AS s FROM part)
SELECT id, CASE WHEN length(w) < 5 THEN '' ELSE w END AS what, CASE WHEN length(w) < 5 THEN '' ELSE y END AS why, CASE WHEN length(w) < 5 THEN '' ELSE s END AS scope, CASE WHEN length(w) < 5 THEN 'what is too short' ELSE '' END AS problem FROM x""")
def fn_coerced_summary(spark, sf_dir):
    k = F.col("p_partkey")
    what = F.when(k % 4 == 0, " abc ").otherwise(_cat(" ", F.col("p_name"), " café"))
    made = T.coerced_summary(what, _cat("because of Straße ", F.col("p_type")), F.when(k % 6 == 0, "some").otherwise(" "))
    p = view(spark, sf_dir, "part").select(k.alias("id"), made.alias("m"))
    return p.select("id", *(F.coalesce(F.col(f"m.{c}"), F.lit("")).alias(c) for c in ("what", "why", "scope", "problem")))


@query("""WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'abc' ELSE p_name END AS w, CASE p_partkey % 5 WHEN 0 THEN 'short' ELSE concat('because of ', p_type, ' and so on') END AS y, CASE WHEN p_partkey % 6 = 0 THEN repeat('s', 101) WHEN p_partkey % 7 = 0 THEN repeat('z', 90) END AS s FROM part)
SELECT id, CASE WHEN length(w) < 5 THEN 'what is too short' WHEN length(y) < 15 THEN 'why is too short' WHEN length(coalesce(s, '')) > 100 THEN 'scope is too long' WHEN length(w) + length(y) + 4 + length(coalesce(concat('; ', s), '')) > 280 THEN 'summary is too long' ELSE 'none' END AS problem FROM x""")
def fn_summary_problem(spark, sf_dir):
    k = F.col("p_partkey")
    what, why = F.when(k % 4 == 0, "abc").otherwise(F.col("p_name")), F.when(k % 5 == 0, "short").otherwise(_cat("because of ", F.col("p_type"), " and so on"))
    scope = F.when(k % 6 == 0, F.repeat(F.lit("s"), 101)).when(k % 7 == 0, F.repeat(F.lit("z"), 90))
    return view(spark, sf_dir, "part").select(k.alias("id"), F.coalesce(T.summary_problem(what, why, scope), F.lit("none")).alias("problem"))


@query("SELECT DISTINCT w AS name, regexp_matches(trim(w), '^[A-Za-z0-9][A-Za-z0-9 ._''-]{0,127}$') AND NOT contains(trim(w), '..') AS safe FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) AS x WHERE w <> ''")
def fn_safe_name(spark, sf_dir):
    w = view(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("name")).where("name <> ''").distinct()
    return w.select("name", T.is_safe_name("name").alias("safe"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('s', conv_id) ELSE concat('s', conv_id, '_turn_x') END AS session FROM conversations")
def fn_strip_turn(spark, sf_dir):
    t = F.col("turn")
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_turn(_cat("s", F.col("conv_id"), "_turn_", F.when(t % 2 == 0, t.cast("string")).otherwise("x"))).alias("session"))


@query("SELECT p_partkey AS id, length(trim(lower(p_name))) >= 8 AND lower(p_name) <> 'something' AS discriminative FROM part")
def fn_discriminative(spark, sf_dir):
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.is_discriminative("p_name", ["something"]).alias("discriminative"))


def _signals(c: str, signals: list[str]) -> str:
    return " + ".join(f"CAST(contains({c}, '{s.replace(chr(39), chr(39) * 2)}') AS INT)" for s in signals)


@query(
    "WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN "
    + f"{_signals('t', halls.QUESTION_ASSISTANT)} > 0 THEN 'hall_assistant,hall_general' WHEN {_signals('t', halls.QUESTION_PREFERENCE)} > 0 THEN 'hall_preferences,hall_general' "
    + f"WHEN {_signals('t', halls.QUESTION_EVENT)} > 0 THEN 'hall_events,hall_facts,hall_general' WHEN {_signals('t', halls.QUESTION_FACT)} > 0 THEN 'hall_facts,hall_general' ELSE 'hall_general' END AS halls FROM q"
)
def fn_question_halls(spark, sf_dir):
    return view(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(halls.question_halls("text"), ",").alias("halls"))


@query("SELECT DISTINCT w AS word, regexp_replace(strip_accents(replace(replace(replace(replace(w, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')), '[^\\x00-\\x7F]', '', 'g') AS folded FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS w FROM documents) AS x")
def fn_fold_ascii(spark, sf_dir):
    w = view(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", T.fold_ascii("word").alias("folded"))


@query("""WITH t AS (SELECT c_custkey AS id, concat(concat(upper(substring(c_mktsegment, 1, 1)), lower(substring(c_mktsegment, 2))), ' met Alice and The ', c_nationkey, ' Bobs in Paris') AS text FROM customer), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{2,15}\\b')) AS name FROM t)
SELECT id, name FROM w WHERE lower(name) NOT IN ('the', 'bobs') AND lower(name) NOT IN ('alice')""")
def entity_unknown_candidates(spark, sf_dir):
    seg = F.col("c_mktsegment")
    text = _cat(F.upper(F.substring(seg, 1, 1)), F.lower(F.substr(seg, F.lit(2))), " met Alice and The ", F.col("c_nationkey"), " Bobs in Paris")
    known = spark.range(1).select(F.lit("ALICE").alias("name"))
    return entities.unknown_candidates(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text")), known, ["the", "bobs"]).select("id", "name")
