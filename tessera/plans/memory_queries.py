"""Queries of segments, memories, enrichment and merges, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import lexicons as X
from tessera.functions import text as T
from tessera.functions.segments import segments
from tessera.operators import enrich, merges
from tessera.plans.fixtures import view, with_views
from tessera.plans.text_queries import _MOOD, _S, _SOLVED

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


# ---- segments ----

# users' messages as paragraphs, as quoted turns or as lines, by the user's number
_SEGMENTS = """g AS (SELECT user_id, list(CASE WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN concat('> ', text) ELSE text END ORDER BY event_id) AS g FROM event_messages GROUP BY user_id),
t AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN array_to_string(g, concat(chr(10), chr(10))) ELSE array_to_string(g, chr(10)) END AS text FROM g),
l AS (SELECT user_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM t),
f AS (SELECT *, regexp_matches(trim(line, concat(' ', chr(9), chr(13))), '(?i)^(>\\s|(human|user|q|assistant|ai|a|claude|chatgpt)\\s*:)') AS opens FROM l),
n AS (SELECT user_id, count(*) FILTER (WHERE opens) AS n_turns, count(*) AS n_lines FROM f GROUP BY user_id),
tu AS (SELECT user_id, g AS k, array_to_string(list(line ORDER BY pos), chr(10)) AS content FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM f) AS x GROUP BY user_id, g),
pa AS (SELECT user_id, k, content FROM (SELECT user_id, unnest(string_split(text, concat(chr(10), chr(10)))) AS content, unnest(range(0, len(string_split(text, concat(chr(10), chr(10)))))) AS k FROM t) AS x WHERE trim(content) <> ''),
np AS (SELECT user_id, count(*) AS n_paragraphs FROM pa GROUP BY user_id),
gr AS (SELECT user_id, pos // 25 AS k, array_to_string(list(line ORDER BY pos), chr(10)) AS content FROM f GROUP BY user_id, pos // 25),
a AS (SELECT user_id, k, content FROM tu JOIN n USING (user_id) WHERE n_turns >= 3 UNION ALL SELECT user_id, k, content FROM gr JOIN n USING (user_id) JOIN np USING (user_id) WHERE n_turns < 3 AND n_paragraphs <= 1 AND n_lines > 20
  UNION ALL SELECT user_id, k, content FROM pa JOIN n USING (user_id) JOIN np USING (user_id) WHERE n_turns < 3 AND NOT (n_paragraphs <= 1 AND n_lines > 20)),
seg AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS INT) AS segment_index, content FROM a WHERE trim(content) <> '')"""


def _user_texts(spark, sf_dir):
    m = view(spark, sf_dir, "event_messages")
    quoted = (F.col("user_id") % 3 == 1) & (F.col("event_id") % 2 == 0)
    m = m.withColumn("text", F.when(quoted, F.concat(F.lit("> "), "text")).otherwise(F.col("text")))
    m = m.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda x: x["text"]).alias("lines"))
    return m.select("user_id", F.when(F.col("user_id") % 3 == 0, F.array_join("lines", "\n\n")).otherwise(F.array_join("lines", "\n")).alias("text"))


@query(f"WITH {_SEGMENTS} SELECT user_id, segment_index, content FROM seg")
def ingest_segments(spark, sf_dir):
    return segments(_user_texts(spark, sf_dir))


@query(
    f"WITH {_SEGMENTS}, x AS (SELECT user_id, segment_index, content, lower(content) AS t, length(content) AS len, list_distinct(regexp_extract_all(lower(content), '[A-Za-z0-9_]+')) AS w FROM seg), s AS (SELECT user_id, segment_index, content, len, "
    + ", ".join(f"{v} AS {k}" for k, v in _S.items())
    + f", {_SOLVED} AS solved, {_MOOD} FROM x), b AS (SELECT *, greatest(decision, preference, milestone, problem, emotional) AS best FROM s), k AS (SELECT *, CASE "
    + " ".join(f"WHEN {k} = best THEN '{k}'" for k in X.MARKERS)
    + " END AS kind, least(1.0e0, (best + CASE WHEN len > 500 THEN 2 WHEN len > 200 THEN 1 ELSE 0 END) / 5.0e0) AS conf FROM b) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY segment_index) - 1 AS INT) AS chunk_index, content, "
    "CASE WHEN kind = 'problem' AND solved AND emotional > 0 AND p > n THEN 'emotional' WHEN kind = 'problem' AND solved THEN 'milestone' WHEN kind = 'problem' AND p > n AND milestone > 0 THEN 'milestone' "
    "WHEN kind = 'problem' AND p > n AND emotional > 0 THEN 'emotional' ELSE kind END AS memory_type, round(conf, 6) AS confidence FROM k WHERE len >= 20 AND best > 0 AND conf >= 0.3"
)
def ingest_memories(spark, sf_dir):
    """Memories of every segment of the users' texts."""
    m = T.extract_memories(_user_texts(spark, sf_dir), "user_id")
    return m.select("user_id", "chunk_index", "content", "memory_type", F.round("confidence", 6).alias("confidence"))


# ---- enrichment ----

# contexts of 13 vectors each; every third emit repeats an earlier vector under a new text, some texts repeat
_EMITS = """v AS (SELECT vec_id AS i, vec_id % 13 AS c, vec_id // 13 AS p, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT v.i, v.c, v.p, concat('ask ', v.p // 3 * 3 + least(v.p % 3, 1), ' of ', v.c) AS text, coalesce(o.e, v.e) AS e, concat('Word', v.p % 9) AS kw, concat('Thing ', v.p % 7) AS ent FROM v LEFT JOIN v AS o ON v.p % 4 = 3 AND o.c = v.c AND o.p = v.p - 4),
em AS (SELECT concat('ctx_', c) AS context_id, CAST(p // 2 AS BIGINT) AS seq, list(text ORDER BY p) AS queries, list(e ORDER BY p) AS vectors, list(kw ORDER BY p) AS keywords, list(concat('thing_', split_part(ent, ' ', 2)) ORDER BY p) AS entities FROM q WHERE p >= 4 GROUP BY c, p // 2),
st AS (SELECT concat('ctx_', c) AS context_id, list(text ORDER BY p) AS queries, list(e ORDER BY p) AS vectors, ['word1', 'old'] AS keywords, ['thing_1'] AS entities FROM q WHERE p < 4 GROUP BY c),
n AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY seq) AS k FROM em),
r AS (SELECT context_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, queries, vectors, keywords, entities, 0 AS added_queries, 0 AS dropped_queries, 0 AS added_keywords, 0 AS added_entities, 0 AS evicted_views FROM st
  UNION ALL SELECT context_id, k, seq, list_concat(old_q, [nq[i] FOR i IN fresh])[-20:], list_concat(old_v, [nv[i] FOR i IN fresh])[-20:], list_concat(old_k, fresh_k), list_concat(old_e, fresh_e), len(fresh), len(exact) - len(fresh), len(fresh_k), len(fresh_e), greatest(0, len(old_q) + len(fresh) - 20)
  FROM (SELECT *, list_filter(exact, lambda i: len(old_v) = 0 OR list_max(list_transform(old_v, lambda o: list_cosine_similarity(o, nv[i]))) < 0.85) AS fresh FROM (SELECT n.context_id, n.k, n.seq, r.queries AS old_q, r.vectors AS old_v, r.keywords AS old_k, r.entities AS old_e, n.queries AS nq, n.vectors AS nv,
    list_filter(range(1, len(n.queries) + 1), lambda i: NOT list_contains(r.queries, n.queries[i])) AS exact,
    list_filter(n.keywords, lambda x, i: NOT list_contains(list_transform(r.keywords, lambda y: lower(y)), lower(x)) AND NOT list_contains(list_transform(n.keywords[:i - 1], lambda y: lower(y)), lower(x))) AS fresh_k,
    list_filter(n.entities, lambda x, i: NOT list_contains(r.entities, x) AND NOT list_contains(n.entities[:i - 1], x)) AS fresh_e FROM r JOIN n ON n.context_id = r.context_id AND n.k = r.k + 1) AS a) AS b)"""


def _emits(spark, sf_dir):
    v = view(spark, sf_dir, "embeddings").select((F.col("vec_id") % 13).alias("c"), F.floor(F.col("vec_id") / 13).alias("p"), F.col("embedding").cast("array<double>").alias("e"))
    o = v.select(F.col("c"), (F.col("p") + 4).alias("p"), F.col("e").alias("old")).where("p % 4 = 3")
    q = v.join(o, ["c", "p"], "left")
    text = F.concat(F.lit("ask "), F.floor(F.col("p") / 3) * 3 + F.least(F.col("p") % 3, F.lit(1)), F.lit(" of "), "c")
    item = F.struct("p", text.alias("q"), F.coalesce("old", "e").alias("v"), F.concat(F.lit("Word"), F.col("p") % 9).alias("k"), F.concat(F.lit("Thing "), F.col("p") % 7).alias("t"))
    q = q.select(F.concat(F.lit("ctx_"), "c").alias("context_id"), "p", item.alias("x"))

    def gathered(df, *by):
        g = df.groupBy("context_id", *by).agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["p"] - b["p"]).cast("int")).alias("x"))
        part = lambda f: F.transform("x", lambda y: y[f])
        return g.select("context_id", *by, part("q").alias("queries"), part("v").alias("vectors"), part("k").alias("keywords"), part("t").alias("entities"))

    state = gathered(q.where("p < 4")).withColumn("keywords", F.array(F.lit("word1"), F.lit("old"))).withColumn("entities", F.array(F.lit("Thing 1")))
    return state, gathered(q.where("p >= 4").withColumn("seq", F.floor(F.col("p") / 2)), "seq")


@query(f"WITH RECURSIVE {_EMITS} SELECT context_id, array_to_string(queries, '; ') AS queries, array_to_string(keywords, '; ') AS keywords, array_to_string(entities, '; ') AS entities FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY k DESC) AS last FROM r) AS x WHERE last = 1")
def fb_enrich_contexts(spark, sf_dir):
    """Contexts after all emits, full lists of 20 views among them."""
    e = enrich.enrich(*_emits(spark, sf_dir))
    return e.select("context_id", *(F.array_join(c, "; ").alias(c) for c in ("queries", "keywords", "entities")))


@query(f"WITH RECURSIVE {_EMITS} SELECT context_id, seq, added_queries, dropped_queries, added_keywords, added_entities, evicted_views FROM r WHERE k > 0")
def fb_enrichment_log(spark, sf_dir):
    return enrich.enrichment_log(*_emits(spark, sf_dir))


# ---- merges ----

# customers went into one another in chains of up to 16, every 64 of them with a chain that ends in a circle; the rest stand
_MERGED = """k AS (SELECT c_custkey AS i FROM customer), tomb AS (SELECT concat('customer_', i) AS id, concat('customer_', CASE WHEN i % 64 = 3 THEN i + 2 WHEN i % 16 <> 0 THEN i - 1 END) AS target FROM k WHERE (i % 16 <> 0 OR i % 64 = 3) AND i > 1),
walk AS (SELECT id, target AS place, 1 AS steps FROM tomb UNION ALL SELECT w.id, t.target, steps + 1 FROM walk AS w JOIN tomb AS t ON t.id = w.place WHERE steps < 40),
ends AS (SELECT id, place AS canonical FROM walk WHERE place NOT IN (SELECT id FROM tomb)),
canon AS (SELECT id, canonical FROM ends UNION ALL SELECT id, min(place) FROM walk WHERE steps > 20 AND id NOT IN (SELECT id FROM ends) GROUP BY id)"""


def _tombstones(spark, sf_dir):
    i = F.col("c_custkey")
    into = F.when(i % 64 == 3, i + 2).when(i % 16 != 0, i - 1)
    return view(spark, sf_dir, "customer").where("c_custkey > 1").select(F.concat(F.lit("customer_"), i).alias("id"), F.concat(F.lit("customer_"), into).alias("into")).where("into IS NOT NULL")


@query(f"WITH RECURSIVE {_MERGED} SELECT id, canonical FROM canon")
def kg_merged_chains(spark, sf_dir):
    return merges.canonical_ids(_tombstones(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_MERGED}, act AS (SELECT id FROM entities WHERE status = 'active'), p AS (SELECT concat('customer_', o_custkey) AS a0, CASE WHEN o_orderkey % 11 = 0 THEN 'someone' WHEN o_orderkey % 13 = 0 THEN concat('customer_', o_custkey - 1) ELSE concat('nation_', o_orderkey % 25) END AS b0,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 / 10.0e0 END AS w, concat('flag_', o_orderkey % 40) AS ctx FROM orders),
c AS (SELECT p.*, coalesce(x.canonical, a0) AS a, coalesce(y.canonical, b0) AS b, coalesce(w, 0.7e0) AS weight FROM p LEFT JOIN canon AS x ON x.id = a0 LEFT JOIN canon AS y ON y.id = b0),
ed AS (SELECT DISTINCT least(subject, object) AS f, greatest(subject, object) AS t FROM triples WHERE valid_to IS NULL OR valid_to = ''),
j AS (SELECT c.*, least(a, b) AS f, greatest(a, b) AS t, CASE WHEN a NOT IN (SELECT id FROM act) OR b NOT IN (SELECT id FROM act) THEN 'phantom' WHEN a = b THEN 'self_loop' WHEN (least(a, b), greatest(a, b)) IN (SELECT (f, t) FROM ed) THEN 'connected' END AS bad FROM c)
SELECT verdict, count(*) AS n, CAST(round(sum(weight), 6) AS DOUBLE) AS weight FROM (SELECT weight, coalesce(bad, CASE WHEN dense_rank() OVER (PARTITION BY f, t, ctx, bad IS NULL ORDER BY weight DESC, a0, b0) = 1 THEN 'inserted' ELSE 'repeated' END) AS verdict FROM j) AS x GROUP BY verdict""")
def queue_judge_proposals(spark, sf_dir):
    j = merges.judge_proposals(_proposals(spark, sf_dir), view(spark, sf_dir, "entities"), _tombstones(spark, sf_dir), view(spark, sf_dir, "triples"))
    return j.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


def _proposals(spark, sf_dir):
    o = F.col("o_orderkey")
    b = F.when(o % 11 == 0, "someone").when(o % 13 == 0, F.concat(F.lit("customer_"), F.col("o_custkey") - 1)).otherwise(F.concat(F.lit("nation_"), o % 25))
    return view(spark, sf_dir, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("a"), b.alias("b"), F.when(o % 3 != 0, o % 10 / 10.0).alias("w"), F.concat(F.lit("flag_"), o % 40).alias("ctx"))
