"""Queries of contexts, diaries, conflicts, profiles, templates and transcripts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import records
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


_J = lambda c: f"array_to_string({c}, ';')"


@query(f"""
WITH c AS (SELECT c_custkey AS id, [x FOR x IN [c_name, ' ', c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'third' END, 'four', 'five', 'six'][:c_custkey % 8] IF trim(coalesce(x, '')) <> ''] AS q, [x FOR x IN ['tea', '', 'pot', 'cup', 'jug', 'mug', 'pan'][:1 + c_custkey % 7] IF x <> ''] AS k,
  [x FOR x IN list_transform(range(0, c_custkey % 13), lambda i: concat('e', i))] AS e FROM customer), p AS (SELECT *, CASE WHEN len(q) < 2 THEN 'queries' WHEN len(k) < 2 THEN 'keywords' WHEN len(e) < 1 THEN 'entities' ELSE 'none' END AS problem FROM c)
SELECT id, problem, CASE WHEN problem = 'none' THEN {_J('q[:5]')} ELSE '' END AS queries, CASE WHEN problem = 'none' THEN {_J('k[:5]')} ELSE '' END AS keywords, CASE WHEN problem = 'none' THEN {_J('e[:10]')} ELSE '' END AS entities FROM p""")
def fn_validate_context(spark, sf_dir):
    n = F.col("c_custkey")
    q = F.slice(F.array("c_name", F.lit(" "), "c_mktsegment", F.when(n % 5 != 0, "third"), F.lit("four"), F.lit("five"), F.lit("six")), F.lit(1), (n % 8).cast("int"))
    k = F.slice(F.array(*map(F.lit, ["tea", "", "pot", "cup", "jug", "mug", "pan"])), F.lit(1), (1 + n % 7).cast("int"))
    e = F.filter(F.transform(F.sequence(F.lit(0), (n % 13).cast("int")), lambda i: F.when(i < n % 13, F.concat(F.lit("e"), i))), lambda x: x.isNotNull())
    c = records.validate_contexts(view(spark, sf_dir, "customer").select(n.alias("id"), q.alias("queries"), k.alias("keywords"), e.alias("entities")))
    return c.select("id", F.coalesce("problem", F.lit("none")).alias("problem"), *(F.coalesce(F.array_join(x, ";"), F.lit("")).alias(x) for x in records.ARITY))


@query("""
WITH f AS (SELECT l_orderkey % 50 AS query_id, concat('v', l_partkey) AS id, round(1.0e0 / (60 + l_suppkey), 9) AS rrf FROM lineitem), o AS (SELECT concat('v', p_partkey) AS id, concat('class_', p_size) AS owner_id FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT query_id, coalesce(owner_id, f.id) AS id, max(rrf) AS s FROM f LEFT JOIN o ON o.id = f.id GROUP BY 1, 2), r AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS INT) AS context_rank, round(s, 6) AS context_score FROM b),
h AS (SELECT q.query_id, c.id FROM (SELECT DISTINCT query_id FROM f) AS q, (SELECT DISTINCT concat('class_', p_size) AS id FROM part WHERE p_size < 10) AS c)
SELECT h.query_id, h.id, coalesce(context_rank, -1) AS context_rank, coalesce(context_score, -1.0e0) AS context_score FROM h LEFT JOIN r USING (query_id, id)""")
def rank_attach_context(spark, sf_dir):
    f = view(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), F.concat(F.lit("v"), "l_partkey").alias("id"), F.round(1.0 / (60 + F.col("l_suppkey")), 9).alias("rrf"))
    p = view(spark, sf_dir, "part")
    o = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("v"), "p_partkey").alias("id"), F.concat(F.lit("class_"), "p_size").alias("owner_id"))
    h = f.select("query_id").distinct().join(p.where("p_size < 10").select(F.concat(F.lit("class_"), "p_size").alias("id")).distinct())
    r = records.attach_context_rank(h, f, o)
    return r.select("query_id", "id", F.coalesce("context_rank", F.lit(-1)).alias("context_rank"), F.coalesce("context_score", F.lit(-1.0)).alias("context_score"))


def _entries(spark, sf_dir):
    o = F.col("o_orderkey")
    return view(spark, sf_dir, "orders").select(
        F.concat(F.lit("The Agent"), F.col("o_custkey") % 20).alias("agent"), F.when(o % 9 == 0, " ").otherwise(F.concat(F.lit("entry "), o)).alias("entry"), F.when(o % 4 == 0, F.concat(F.lit("Session "), o, F.lit(": done!"))).alias("slug"),
        F.when(o % 3 == 0, "Plans & Ideas").alias("topic"), F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + o % 86400).alias("at"),
    )


_DIARY = """e AS (SELECT concat('The Agent', o_custkey % 20) AS agent, concat('entry ', o_orderkey) AS entry, CASE WHEN o_orderkey % 4 = 0 THEN concat('session-', o_orderkey, '-done') END AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'Plans & Ideas' ELSE 'general' END AS topic,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400) AS moment, o_custkey % 20 AS k FROM orders WHERE o_orderkey % 9 <> 0),
d AS (SELECT concat('diary_agent', k, '_', coalesce(slug, concat(strftime(moment, '%Y%m%d-%H%M%S'), CASE topic WHEN 'general' THEN '-general' ELSE '-plans-ideas' END))) AS id, entry AS text, agent AS added_by, topic, strftime(moment, '%Y-%m-%d') AS date, strftime(moment, '%Y-%m-%dT%H:%M:%S') AS filed_at FROM e)"""


@query(f"WITH {_DIARY} SELECT id, text, added_by, topic, 'diary_entry' AS type, 'diary' AS content_type, date, filed_at FROM d")
def diary_write(spark, sf_dir):
    return records.diary_records(_entries(spark, sf_dir))


@query(f"""WITH {_DIARY}, r AS (SELECT *, row_number() OVER (PARTITION BY added_by ORDER BY filed_at DESC, id) AS position, count(*) OVER (PARTITION BY added_by) AS total FROM d)
SELECT added_by, CAST(position AS INT) AS position, date, filed_at AS timestamp, topic, text AS content, total FROM r WHERE position <= 10 AND added_by IN ('The Agent3', 'The Agent4')""")
def diary_read(spark, sf_dir):
    asked = spark.sql("SELECT * FROM VALUES ('The Agent3'), ('The Agent4'), ('The Agent4'), ('Nobody') AS t(agent)")
    return records.read_diary(records.diary_records(_entries(spark, sf_dir)), asked)


_LEDGER = """led AS (SELECT concat('customer_', o_custkey) AS existing_id, concat('n', o_orderkey % 3) AS new_id, 'duplicate' AS conflict_type, o_orderkey AS conflict_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at, CASE o_orderstatus WHEN 'F' THEN 'merge' ELSE 'keep' END AS action, concat(o_orderpriority, ' ', CASE WHEN o_orderkey % 2 = 0 THEN repeat('x', 120) ELSE '' END) AS reason FROM orders),
past AS (SELECT existing_id, new_id, arg_max(action, k) AS action, arg_max(created_at, k) AS moment, arg_max(reason, k) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY existing_id, new_id ORDER BY created_at, conflict_id) AS k FROM led) AS x GROUP BY existing_id, new_id),
pen AS (SELECT concat('c', c_custkey) AS id, concat('customer_', c_custkey) AS existing_id, concat('n', c_custkey % 4) AS new_id, c_nationkey FROM customer WHERE c_custkey % 6 <> 0)"""


def _conflicts(spark, sf_dir):
    c = F.col("c_custkey")
    open_ = view(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), c).alias("id"), F.lit("duplicate").alias("conflict_type"), F.lit("near").alias("reason"), F.concat(F.lit("customer_"), c).alias("existing_id"), F.col("c_name").alias("existing_preview"),
        F.concat(F.lit("n"), c % 4).alias("new_id"), F.lit(0.9).alias("similarity"), F.when(c % 6 == 0, "2024-01-01").alias("resolved_at"),
    )
    o = F.col("o_orderkey")
    ledger = view(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer_"), "o_custkey").alias("existing_id"), F.concat(F.lit("n"), o % 3).alias("new_id"), F.lit("duplicate").alias("conflict_type"), o.alias("conflict_id"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "merge").otherwise("keep").alias("action"), F.concat("o_orderpriority", F.lit(" "), F.when(o % 2 == 0, F.repeat(F.lit("x"), 120)).otherwise("")).alias("reason"),
    )
    return records.pending_conflicts(open_, ledger)


@query(f"WITH {_LEDGER} SELECT id, pen.existing_id, pen.new_id, coalesce(action, 'none') AS action, coalesce(moment, '') AS decided FROM pen LEFT JOIN past ON past.existing_id = pen.existing_id AND past.new_id = pen.new_id")
def queue_pending_conflicts(spark, sf_dir):
    p = F.col("past_resolution")
    return _conflicts(spark, sf_dir).select("id", "existing_id", "new_id", F.coalesce(p["action"], F.lit("none")).alias("action"), F.coalesce(p["when"], F.lit("")).alias("decided"))


@query(f"""WITH {_LEDGER}, h AS (SELECT pen.new_id, id, concat('  • ', id, ': last time you chose ''', action, ''' (', moment, ') — ', CASE WHEN length(trim(reason)) > 100 THEN concat(substring(trim(reason), 1, 97), '...') ELSE trim(reason) END) AS line FROM pen JOIN past ON past.existing_id = pen.existing_id AND past.new_id = pen.new_id)
SELECT new_id, concat('Past resolutions on matching conflicts (use as guidance, still your call):', chr(10), array_to_string(list(line ORDER BY id), chr(10))) AS hint FROM h GROUP BY new_id""")
def queue_resolution_hints(spark, sf_dir):
    return records.resolution_hints(_conflicts(spark, sf_dir), ["new_id"])


@query("""
WITH c AS (SELECT p_partkey AS k, p_name, p_size, concat('tool', p_size % 20) AS tool FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY p_size DESC, p_name DESC, concat('part_', k)) AS n FROM c)
SELECT tool, concat('part_', k) AS id, CASE WHEN k % 4 = 0 THEN concat('{"a":', k, '}') ELSE '{}' END AS slots FROM r WHERE n = 1 AND tool <> 'tool7'""")
def kg_operation_profile(spark, sf_dir):
    """Parts as classes of operations, each with a tool."""
    k = F.col("p_partkey")
    p = view(spark, sf_dir, "part")
    profile = F.struct(F.concat(F.lit("tool"), F.col("p_size") % 20, F.lit(" ")).alias("tool"), F.when(k % 4 == 0, F.struct(k.alias("a"))).alias("slots"))
    e = p.select(F.concat(F.lit("part_"), k).alias("id"), F.lit("class").alias("kind"), F.when(k % 7 == 0, "deleted").otherwise("active").alias("status"), F.col("p_size").alias("importance"), F.col("p_name").alias("last_touched"), F.to_json(F.struct(profile.alias("rules_profile"))).alias("properties"))
    t = p.select(F.concat(F.lit("part_"), k).alias("subject"), F.lit("is_a").alias("predicate"), F.when(k % 2 == 0, "operation").otherwise("thing").alias("object"), F.lit(None).cast("string").alias("valid_to"))
    tools = p.select(F.concat(F.lit("tool"), F.col("p_size") % 20).alias("tool")).where("tool <> 'tool7'")
    return records.operation_profiles(tools, e, t)


_TEMPLATES = "t AS (SELECT l_orderkey AS k, list(concat('op_', l_partkey) ORDER BY l_linenumber, concat('op_', l_partkey)) AS ops FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)"


@query(f"""WITH {_TEMPLATES} SELECT concat('record_op_template_', sha1(array_to_string(list_sort(ops), '|'))[:12]) AS id, concat('recipe of ', k) AS title, 'use when' || CASE WHEN k % 2 = 0 THEN ' parts are ordered together' ELSE concat(' (operation template covering ', len(ops), ' clustered operations)') END AS why,
concat('# recipe of ', k, repeat(chr(10), 2), '## When to use', chr(10), 'use when', CASE WHEN k % 2 = 0 THEN ' parts are ordered together' ELSE '' END, repeat(chr(10), 2), '## Recipe', chr(10), 'do it', CASE WHEN k % 3 = 0 THEN concat(repeat(chr(10), 2), '## Failure modes', chr(10), '- late', chr(10), '- lost') ELSE '' END, repeat(chr(10), 2), 'Derived from ', len(ops), ' operation(s): ', array_to_string(ops, ', ')) AS content,
concat('derived from ', len(ops), ' clustered operations') AS scope FROM t""")
def kg_operation_templates(spark, sf_dir):
    made, _ = records.operation_templates(_clusters(spark, sf_dir))
    return made.select("id", "title", "why", "content", "scope")


def _clusters(spark, sf_dir):
    ops = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("op_"), "l_partkey").alias("o")))), lambda x: x["o"])
    c = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(ops.alias("op_ids"))
    use = F.concat(F.lit("use when"), F.when(F.col("k") % 2 == 0, " parts are ordered together").otherwise(""))
    modes = F.when(F.col("k") % 3 == 0, F.array(F.lit("late "), F.lit(" "), F.lit("lost")))
    return c.select("op_ids", F.concat(F.lit(" recipe of "), "k").alias("title"), use.alias("when_to_use"), F.lit("do it").alias("recipe"), modes.alias("failure_modes"))


@query(f"WITH {_TEMPLATES} SELECT DISTINCT concat('record_op_template_', sha1(array_to_string(list_sort(ops), '|'))[:12]) AS subject, 'templatizes' AS predicate, unnest(ops) AS object FROM t")
def kg_template_edges(spark, sf_dir):
    return records.operation_templates(_clusters(spark, sf_dir))[1]


@query("""
WITH s AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN text END) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN concat('2024-', CASE WHEN conv_id % 2 = 0 THEN '03' ELSE '11' END, '-0', 1 + conv_id % 9, '_', '905PM') ELSE '' END AS stamp, CASE WHEN conv_id % 4 = 0 THEN concat('Jo,', (SELECT n_name FROM nation WHERE n_nationkey = 0)) WHEN conv_id % 4 = 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = 1) ELSE '' END AS people, CASE WHEN conv_id % 5 = 0 THEN 'session' ELSE concat('Please-look-at-item-', conv_id) END AS subject FROM s""")
def ingest_session_metadata(spark, sf_dir):
    """Transcripts made of conversations, with a time line, names of nations and prompts."""
    i = F.col("conv_id")
    c = view(spark, sf_dir, "conversations").select("conv_id").distinct()
    stamp = F.when(i % 3 == 0, F.concat(F.lit("⏺ 9:05 PM Monday, "), F.when(i % 2 == 0, "March").otherwise("November"), F.lit(" "), 1 + i % 9, F.lit(", 2024"))).otherwise("no time")
    name = {r.n_nationkey: r.n_name for r in view(spark, sf_dir, "nation").where("n_nationkey < 2").collect()}
    who = F.when(i % 4 == 0, f"in /Users/jdoe/src {name[0].title()} said").when(i % 4 == 1, f"hello {name[1].lower()}").otherwise(f"nobody {name[1]}ian")
    ask = F.when(i % 5 == 0, "> ls -la /tmp").otherwise(F.concat(F.lit("> Please look, at item "), i, F.lit("!")))
    t = c.select("conv_id", F.concat_ws("\n", F.lit("header"), stamp, who, F.lit("> cd here"), F.lit("> short"), ask, F.lit("> a later prompt of the user")).alias("text"))
    t = t.withColumn("text", F.when(i % 5 == 0, F.replace("text", F.lit("> a later prompt of the user"), F.lit("> git status"))).otherwise(F.col("text")))
    people = view(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    users = spark.sql("SELECT * FROM VALUES ('jdoe', 'Jo') AS t(username, name)")
    m = records.session_metadata(t, people, users)
    return m.select("conv_id", F.coalesce("stamp", F.lit("")).alias("stamp"), F.array_join("people", ",").alias("people"), "subject")
