"""Queries of views, gates, layers and halls, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import halls
from tessera.operators import services, state, vector
from tessera.plans.fixtures import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS q, max(text) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY conv_id),
v AS (SELECT conv_id, len(q) AS n, CASE WHEN coalesce(s, '') <> '' THEN list_append(q, s) ELSE q END AS v FROM c WHERE q IS NOT NULL),
e AS (SELECT conv_id, n, unnest(v) AS text, unnest(range(0, len(v))) AS i FROM v)
SELECT CAST(conv_id AS STRING) AS owner_id, CAST(i AS INT) AS view_index, concat(conv_id, '__v', i) AS view_id, text, i = n AS is_summary_view FROM e""")
def views_explode(spark, sf_dir):
    m = view(spark, sf_dir, "conversations")
    q = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    e = m.groupBy(F.col("conv_id").cast("string").alias("id")).agg(q.alias("queries"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("summary"))
    return services.explode_views(e.where(F.size("queries") > 0))


@query("""
WITH p AS (SELECT concat('part_', p_partkey) AS id, p_name AS what, concat('it is of type ', p_type) AS why, CASE WHEN p_size > 25 THEN p_brand END AS scope FROM part)
SELECT id AS owner_id, 'abstract' AS view_kind, id AS view_id, concat(what, ' -- ', why, CASE WHEN scope IS NULL THEN '' ELSE concat('; ', scope) END) AS text FROM p
UNION ALL SELECT id, 'identity', concat(id, '__identity'), what FROM p UNION ALL SELECT id, 'probe', concat(id, '__v0'), concat('about ', what) FROM p""")
def views_three_levels(spark, sf_dir):
    p = view(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), "p_partkey").alias("id"), F.col("p_name").alias("what"), F.concat(F.lit("it is of type "), "p_type").alias("why"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("scope"), F.array(F.concat(F.lit("about "), "p_name")).alias("probes"),
    )
    return services.three_levels(p)


@query("""
WITH x AS (SELECT user_id AS query_id, concat('m', event_id % 12) AS id, event_id, event_type <> 'error' AS keep FROM events WHERE event_id % 12 < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY event_id) AS k FROM x) SELECT query_id, id, keep FROM r WHERE k = 1""")
def gate_decisions(spark, sf_dir):
    """Replies as a judge would send them, one for each user, with ids that aren't known."""
    e = view(spark, sf_dir, "events").withColumn("id", F.concat(F.lit("m"), F.col("event_id") % 12))
    one = F.struct("event_id", F.to_json(F.struct("id", F.when(F.col("event_type") == "error", "drop").otherwise("keep").alias("action"))).alias("j"))
    reply = F.concat(F.lit('{"decisions":['), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("]}"))
    replies = e.groupBy(F.col("user_id").alias("query_id")).agg(reply.alias("reply"))
    known = e.where("event_id % 12 < 8").select(F.col("user_id").alias("query_id"), "id")
    return services.parse_decisions(replies, known)


@query("SELECT context_id, concat('doc_', seq) AS memory_id, 2 AS relevance, '2024-02-01' AS ts FROM ratings WHERE label = 0")
def gate_drops(spark, sf_dir):
    r = view(spark, sf_dir, "ratings").select(F.col("context_id").alias("query_id"), F.col("memory_id").alias("id"), (F.col("label") == 1).alias("keep"))
    return services.drops_as_feedback(r, "2024-02-01")


@query("SELECT count(*) AS records, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS tokens FROM documents")
def layer_status(spark, sf_dir):
    return services.stack_status(view(spark, sf_dir, "documents"))


@query("""
WITH t AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user')) AS u, lower(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant')) AS a FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, coalesce(u, '') AS u, coalesce(a, '') AS a, concat(coalesce(u, ''), coalesce(a, '')) AS b FROM t)
SELECT conv_id, CASE WHEN """
    + " + ".join(f"CAST(contains(u, '{s.replace(chr(39), chr(39) * 2)}') AS INT)" for s in halls.PREFERENCE_SIGNALS)
    + " > 0 THEN 'hall_preferences' WHEN "
    + " + ".join(f"CAST(contains(a, '{s}') AS INT)" for s in halls.ADVICE_SIGNALS)
    + " >= 2 THEN 'hall_assistant' WHEN "
    + " + ".join(f"CAST(contains(b, '{s}') AS INT)" for s in halls.EVENT_SIGNALS)
    + " > 0 THEN 'hall_events' WHEN "
    + " + ".join(f"CAST(contains(b, '{s}') AS INT)" for s in halls.FACT_SIGNALS)
    + " >= 2 THEN 'hall_facts' ELSE 'hall_general' END AS hall FROM x")
def fn_session_hall(spark, sf_dir):
    text = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    c = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(text("user").alias("u"), text("assistant").alias("a"))
    return c.select("conv_id", halls.session_hall("u", "a").alias("hall"))


@query("""
SELECT c_name AS subject, 'is_a' AS predicate, c_mktsegment AS object FROM customer UNION ALL SELECT c_name, 'partner_of', concat('n', c_nationkey) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_name, 'loves', concat('thing ', c_custkey % 5) FROM customer UNION ALL SELECT c_name, 'loves', 'chess' FROM customer""")
def facts_to_triples(spark, sf_dir):
    c = view(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n"), "c_nationkey")).alias("partner"),
        F.lit(None).cast("array<string>").alias("parents"), F.array(F.concat(F.lit("thing "), F.col("c_custkey") % 5), F.lit("chess")).alias("interests"),
    )
    return services.facts_to_triples(c)


@query("SELECT user_id AS id, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'error' THEN n END) AS error FROM (SELECT user_id, event_type, CAST(count(*) AS STRING) AS n FROM events GROUP BY user_id, event_type) AS x GROUP BY user_id")
def legacy_metadata_pivot(spark, sf_dir):
    e = view(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return services.pivot_metadata(e, ["click", "error"])


@query("""
WITH r AS (SELECT context_id, memory_id, relevance, label, n_chars, count(*) OVER (PARTITION BY context_id) AS n FROM ratings) SELECT context_id, memory_id, relevance, CAST(relevance >= 3 AS INT) AS label, n_chars AS content_length FROM r WHERE n >= 5""")
def labelled_pairs(spark, sf_dir):
    r = view(spark, sf_dir, "ratings").select("context_id", "memory_id", "relevance", F.lit(None).cast("string").alias("valid_to"))
    c = r.select("context_id", F.array(F.lit("q")).alias("queries")).distinct()
    m = view(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("id"), "text")
    return services.labelled_pairs(r, c, m, least=5).select("context_id", "memory_id", "relevance", "label", F.col("content_length").cast("long").alias("content_length"))


@query("SELECT count(*) FILTER (WHERE o = 'click') AS merged, count(*) FILTER (WHERE o = 'view') AS deferred, count(*) AS flags FROM (SELECT user_id, arg_max(event_type, event_id) AS o FROM events GROUP BY user_id) AS x")
def gardener_counters(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "click", "merged").when(F.col("event_type") == "view", "deferred").otherwise("other")
    t = view(spark, sf_dir, "events").select(F.col("user_id").alias("flag_id"), outcome.alias("outcome"), F.col("event_id").alias("pos"))
    return services.gardener_counters(t).select("merged", "deferred", "flags")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT concat(lpad(CAST(event_id AS VARCHAR), 12, '0'), '_v2') AS rev_id, concat('e', user_id) AS entity_id, 'task_state' AS schema_id, concat('{"status":"pending","subtodos":[],"blocker":"', event_type, '"}') AS payload, '2024-02-01' AS created_at, 2 AS schema_version FROM e WHERE k = 1 AND event_id % 2 = 0""")
def state_migrate_latest(spark, sf_dir):
    e = view(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("rev_id"), F.concat(F.lit("e"), "user_id").alias("entity_id"), F.lit("task_state").alias("schema_id"),
        F.to_json(F.struct(F.lit("pending").alias("status"), F.array(F.col("event_type")).alias("blockers"))).alias("payload"), F.col("ts").cast("string").alias("created_at"), (F.col("event_id") % 2 + 1).cast("int").alias("schema_version"),
    )
    return state.migrate_latest(e, "2024-02-01")


@query()
def rank_pair_scores(spark, sf_dir):
    """All benchmark texts with the documents nearest by the hashing embedder, scored by the lexical stand-in of a cross-encoder."""
    embed = vector.hashing_embedder()
    b = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    d = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = vector.cosine_top_k(b.select("query_id", F.lit(0).alias("view"), embed("query_text").alias("query")), d.select("id", embed("text").alias("embedding")), 20)
    pairs = hits.select("query_id", "id").join(b, "query_id").join(d, "id").select("query_id", "id", F.col("query_text").alias("query"), "text")
    return services.pair_scores(pairs, threshold=0.1)
