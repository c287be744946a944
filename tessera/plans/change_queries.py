"""Queries of actions on queues, runs and entities, of change logs and of spelling, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changes, spelling
from tessera.plans.fixtures import view, with_views
from tessera.streaming import changelog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


# ---- actions ----

_ACTIONS = """a AS (SELECT user_id AS flag_id, event_id AS seq, ts, CASE WHEN event_type IN ('click', 'view') THEN 'bump' WHEN event_type = 'error' THEN 'resolve' ELSE 'other' END AS action, CASE event_id % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'pruned' WHEN 2 THEN 'nonsense' END AS resolution FROM events)"""


@query(f"""
WITH {_ACTIONS}, q AS (SELECT DISTINCT user_id AS flag_id, CAST(user_id % 3 AS BIGINT) AS attempted_count, user_id % 5 = 0 AS closed FROM events),
f AS (SELECT flag_id, arg_min(resolution, seq) AS resolution, min(seq) AS seq FROM (SELECT *, rank() OVER (PARTITION BY flag_id ORDER BY ts, seq) AS r FROM a WHERE action = 'resolve' AND resolution IN ('merged', 'pruned')) AS x WHERE r = 1 GROUP BY flag_id),
e AS (SELECT f.flag_id, f.resolution, a.ts, a.seq FROM f JOIN a ON a.flag_id = f.flag_id AND a.seq = f.seq),
n AS (SELECT a.flag_id, count(*) AS n, max(a.ts) AS last FROM a LEFT JOIN e USING (flag_id) WHERE (a.action = 'bump' OR a.action = 'resolve' AND a.resolution IN ('merged', 'pruned')) AND (e.flag_id IS NULL OR a.ts < e.ts OR a.ts = e.ts AND a.seq <= e.seq) GROUP BY a.flag_id)
SELECT q.flag_id, CASE WHEN closed THEN attempted_count ELSE attempted_count + coalesce(n, 0) END AS attempted_count, CASE WHEN closed THEN TIMESTAMP '2024-01-01 00:00:00' ELSE coalesce(last, TIMESTAMP '2024-01-01 00:00:00') END AS last_attempt_ts, CASE WHEN closed THEN 'deferred' ELSE coalesce(resolution, 'open') END AS resolution FROM q LEFT JOIN n USING (flag_id) LEFT JOIN e USING (flag_id)""")
def queue_flag_actions(spark, sf_dir):
    """Every user a flag, every event an action on it."""
    e = view(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "bump").when(F.col("event_type") == "error", "resolve").otherwise("other")
    four = F.col("event_id") % 4
    named = F.when(four == 0, "merged").when(four == 1, "pruned").when(four == 2, "nonsense")
    acts = e.select(F.col("user_id").alias("flag_id"), F.col("event_id").alias("seq"), "ts", kind.alias("action"), named.alias("resolution"), F.lit(None).cast("string").alias("note"))
    closed, then = F.col("user_id") % 5 == 0, F.lit("2024-01-01 00:00:00").cast(dict(e.dtypes)["ts"])
    queue = e.select(
        F.col("user_id").alias("flag_id"), (F.col("user_id") % 3).alias("attempted_count"), then.alias("last_attempt_ts"), F.when(closed, then).alias("resolved_ts"),
        F.when(closed, "deferred").alias("resolution"), F.lit(None).cast("string").alias("resolution_note"),
    ).distinct()
    out = changes.apply_flag_actions(queue, acts)
    return out.select("flag_id", "attempted_count", "last_attempt_ts", F.coalesce("resolution", F.lit("open")).alias("resolution"))


@query("""
WITH c AS (SELECT o_custkey AS run_id, count(*) AS n, sum(o_orderkey) AS ids FROM orders GROUP BY o_custkey), x AS (SELECT l_suppkey AS run_id, l_orderkey, max(l_linenumber) AS line FROM lineitem GROUP BY l_suppkey, l_orderkey),
l AS (SELECT run_id, max(l_orderkey) AS seq FROM x GROUP BY run_id), z AS (SELECT l.run_id, l.seq, x.line FROM l JOIN x ON x.run_id = l.run_id AND x.l_orderkey = l.seq)
SELECT s_suppkey AS run_id, s_name AS model, coalesce(z.seq, -1) AS last_seq, CASE WHEN z.seq IS NULL THEN -1 ELSE 2 END AS flags_processed, CASE WHEN z.seq IS NULL THEN -1 ELSE CAST(z.line AS INT) END AS merges, CASE WHEN z.seq IS NULL THEN -1 ELSE 0 END AS prunes FROM supplier LEFT JOIN z ON z.run_id = s_suppkey""")
def queue_run_log(spark, sf_dir):
    """Suppliers as runs, their orders as closings, of which the last counts."""
    s = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.lit("2024-01-01").alias("started_ts"), F.col("s_name").alias("model"))
    x = view(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), "l_orderkey").agg(F.max("l_linenumber").alias("line"))
    closed = x.select(
        "run_id", F.col("l_orderkey").alias("seq"), F.lit("2024-01-02").alias("ts"), F.array("l_orderkey", "run_id").alias("flag_ids"), F.create_map(F.lit("merges"), F.col("line").cast("int")).alias("counters"),
        F.lit(0).alias("exit_code"), F.lit("").alias("errors"),
    )
    out = changes.close_runs(s, closed)
    none = lambda c: F.coalesce(c, F.lit(-1))
    return out.select("run_id", "model", none(F.col("flag_ids")[0]).alias("last_seq"), none("flags_processed").alias("flags_processed"), none("merges").alias("merges"), none("prunes").alias("prunes"))


@query("""
WITH u AS (SELECT concat('customer_', o_custkey) AS id, arg_max(o_orderstatus, o_orderkey) AS content, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS d, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 + 1 END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS importance FROM orders GROUP BY o_custkey)
SELECT e.id, coalesce(u.content, e.name) AS content, coalesce(u.importance, e.importance) AS importance, CASE WHEN u.id IS NULL THEN e.last_touched ELSE '2024-07-01' END AS last_touched FROM entities AS e LEFT JOIN u ON u.id = e.id WHERE e.kind = 'entity'""")
def state_update_contents(spark, sf_dir):
    """Orders as updates of customers; two of three leave the importance as it is."""
    e = view(spark, sf_dir, "entities").where("kind = 'entity'").select("id", F.col("name").alias("content"), F.col("importance").cast("long").alias("importance"), "last_touched")
    o = F.col("o_orderkey")
    u = view(spark, sf_dir, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("id"), o.alias("seq"), F.lit("2024-07-01").alias("ts"), F.col("o_orderstatus").alias("content"), F.when(o % 3 == 0, o % 5 + 1).alias("importance"))
    return changes.update_contents(e, u)


@query("SELECT concat('ctx_', c_nationkey) AS context_id, concat('t_customer_', c_custkey) AS triple_id, 'rated_useful' AS kind, c_custkey % 5 + 1 AS relevance, 0.5e0 AS confidence, 'agent' AS rater_kind FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey % 3 = 1")
def fb_triple_feedback(spark, sf_dir):
    c = F.col("c_custkey")
    f = view(spark, sf_dir, "customer").select(
        F.concat(F.lit("ctx_"), "c_nationkey").alias("context_id"), F.concat(F.lit("t_customer_"), c).alias("triple_id"), F.lit("rated_useful").alias("kind"), (c % 5 + 1).alias("relevance"),
        F.lit(0.5).alias("confidence"), F.lit("agent").alias("rater_kind"), F.when(c % 4 == 0, "2024-01-01").alias("valid_to"),
    )
    asked = view(spark, sf_dir, "nation").where("n_nationkey % 3 = 1").select(F.concat(F.lit("ctx_"), "n_nationkey").alias("context_id"))
    return changes.triple_feedback(f, asked.unionByName(asked))


# ---- logs ----


@query("SELECT user_id, event_id, event_type FROM (SELECT *, CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last FROM events) AS x WHERE last")
def log_latest_epoch(spark, sf_dir):
    """Days as epochs: a user's rows of the last day take the place of all before."""
    e = view(spark, sf_dir, "events").withColumn(changelog.EPOCH, F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    return changelog.latest(e, ["user_id"]).select("user_id", "event_id", "event_type")


# ---- spelling ----

_WORDS = "w AS (SELECT w, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,12}')) AS w FROM documents) AS x GROUP BY w), d AS (SELECT w AS word, freq FROM w WHERE freq >= 20), r AS (SELECT w AS asked FROM w WHERE freq < 20)"


@query(f"""
WITH {_WORDS}, n AS (SELECT asked, word, freq, levenshtein(asked, word) AS distance FROM r, d WHERE abs(length(asked) - length(word)) <= 2 AND levenshtein(asked, word) <= 2), k AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, freq DESC, word) AS k FROM n)
SELECT asked, word AS corrected, CAST(distance AS INT) AS distance FROM k WHERE k = 1""")
def text_spelling(spark, sf_dir):
    """Rare words of the documents with the common word that each is nearest to; the SQL compares all pairs."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,12}"), F.lit(0)))
    w = view(spark, sf_dir, "documents").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return spelling.corrections(w.where("freq < 20").select(F.col("word").alias("asked")), w.where("freq >= 20"))
