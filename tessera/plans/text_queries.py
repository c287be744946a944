"""Queries of text functions, ingest, state, queues, rankers and streams, each with its SQL twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import lexicons as X
from tessera.functions import text as T
from tessera.operators import dedup, entities, rankers, state
from tessera.plans.fixtures import view, with_views
from tessera.sources import files
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


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- scalar functions ----

_NAME = "trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'))"


@query(
    "WITH x AS (SELECT p_partkey AS id, concat('The ', p_name, ' ', p_type, '--', p_brand) AS n FROM part), y AS (SELECT id, trim(regexp_replace(lower("
    + _NAME.format(c="trim(n)")
    + "), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM x) SELECT id, coalesce(nullif(regexp_replace(s, '^(the|a|an)_', ''), ''), 'unknown') AS name FROM y"
)
def fn_normalize_entity_name(spark, sf_dir):
    n = F.concat(F.lit("The "), "p_name", F.lit(" "), "p_type", F.lit("--"), "p_brand")
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.normalize_entity_name(n, fold=False).alias("name"))


@query("SELECT DISTINCT o_orderpriority AS raw, trim(regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[-\\s]+', '_', 'g'), '_+', '_', 'g'), '_') AS predicate FROM orders")
def fn_normalize_predicate(spark, sf_dir):
    return view(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw"), T.normalize_predicate("o_orderpriority").alias("predicate")).distinct()


@query("SELECT item_id, regexp_replace(substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50), '-+$', '') AS slug FROM benchmark")
def fn_slugify(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", T.slugify("text").alias("slug"))


@query("SELECT doc_id, concat('record_', lang, '_', substring(sha256(concat(source, doc_id)), 1, 24)) AS id FROM documents")
def fn_record_id(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.record_id("lang", "source", "doc_id").alias("id"))


def _contains_sum(c: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({c}, {_q(w)}) AS INT)" for w in words)


@query(
    "WITH x AS (SELECT event_id, lower(text[:3000]) AS t FROM event_messages), s AS (SELECT event_id, "
    + ", ".join(f"{_contains_sum('t', w)} AS {k}" for k, w in X.CONTENT_TYPE_KEYWORDS.items())
    + " FROM x) SELECT event_id, CASE WHEN greatest(fact, event, discovery, preference, advice) = 0 THEN 'fact' "
    + " ".join(f"WHEN {k} = greatest(fact, event, discovery, preference, advice) THEN '{k}'" for k in X.CONTENT_TYPE_KEYWORDS)
    + " END AS content_type FROM s"
)
def fn_content_type(spark, sf_dir):
    return view(spark, sf_dir, "event_messages").select("event_id", T.detect_content_type("text").alias("content_type"))


def _marker_sum(c: str, patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all({c}, {_q(p)}))" for p in patterns)


@query("WITH x AS (SELECT event_id, lower(text) AS t FROM event_messages) SELECT event_id, " + ", ".join(f"{_marker_sum('t', m)} AS {k}" for k, m in X.MARKERS.items()) + " FROM x")
def fn_marker_scores(spark, sf_dir):
    return view(spark, sf_dir, "event_messages").select("event_id", *(T.marker_score("text", m).cast("long").alias(k) for k, m in X.MARKERS.items()))


_LIST = "[" + ", ".join(_q(w) for w in X.POSITIVE_WORDS) + "]", "[" + ", ".join(_q(w) for w in X.NEGATIVE_WORDS) + "]"
_MOOD = f"len(list_intersect(w, {_LIST[0]})) AS p, len(list_intersect(w, {_LIST[1]})) AS n"


@query(f"WITH x AS (SELECT event_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS w FROM event_messages), y AS (SELECT event_id, {_MOOD} FROM x) SELECT event_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM y")
def fn_sentiment(spark, sf_dir):
    return view(spark, sf_dir, "event_messages").select("event_id", T.sentiment("text").alias("sentiment"))


_S = {k: _marker_sum("t", m) for k, m in X.MARKERS.items()}
_SOLVED = " OR ".join(f"regexp_matches(t, {_q(p)})" for p in X.RESOLUTION_PATTERNS)


@query(
    "WITH x AS (SELECT event_id, lower(text) AS t, length(text) AS len, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS w FROM event_messages), s AS (SELECT event_id, len, "
    + ", ".join(f"{v} AS {k}" for k, v in _S.items())
    + f", {_SOLVED} AS solved, {_MOOD} FROM x), b AS (SELECT *, greatest(decision, preference, milestone, problem, emotional) AS best FROM s), k AS (SELECT *, CASE "
    + " ".join(f"WHEN {k} = best THEN '{k}'" for k in X.MARKERS)
    + " END AS kind, least(1.0e0, (best + CASE WHEN len > 500 THEN 2 WHEN len > 200 THEN 1 ELSE 0 END) / 5.0e0) AS conf FROM b) SELECT event_id, CASE WHEN kind = 'problem' AND solved AND emotional > 0 AND p > n THEN 'emotional' WHEN kind = 'problem' AND solved THEN 'milestone' "
    "WHEN kind = 'problem' AND p > n AND milestone > 0 THEN 'milestone' WHEN kind = 'problem' AND p > n AND emotional > 0 THEN 'emotional' ELSE kind END AS memory_type, round(conf, 6) AS confidence FROM k WHERE len >= 20 AND best > 0 AND conf >= 0.3"
)
def ingest_extract_memories(spark, sf_dir):
    m = T.memory_types(view(spark, sf_dir, "event_messages").select("event_id", "text"))
    return m.select("event_id", "memory_type", F.round("confidence", 6).alias("confidence"))


_STOP = "[" + ", ".join(_q(w) for w in X.PROMPT_STOPWORDS) + "]"


@query(f"SELECT event_id, array_to_string(list_filter(list_distinct_ordered, lambda x: NOT list_contains({_STOP}, x))[:8], ' ') AS keywords FROM (SELECT event_id, list_reduce(list_transform(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9-]{{2,}}'), lambda w: [w]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM event_messages) AS x")
def fn_prompt_keywords(spark, sf_dir):
    return view(spark, sf_dir, "event_messages").select("event_id", F.array_join(T.prompt_keywords("text"), " ").alias("keywords"))


@query()
def fn_sanitize_query(spark, sf_dir):
    q = T.sanitize_query("text")
    return view(spark, sf_dir, "documents").select("doc_id", q["clean_query"].alias("clean_query"), q["method"].alias("method"))


@query("""
WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS k FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT item_id, doc_id, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(t, x))) / len(k)::DOUBLE ELSE 0 END, 6) AS overlap FROM q, d""")
def fn_keyword_overlap(spark, sf_dir):
    """The stated queries, items whose id is divisible by 50, against all documents."""
    q = view(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("k"))
    d = view(spark, sf_dir, "documents").select("doc_id", "text")
    return d.crossJoin(q).select("item_id", "doc_id", F.round(T.keyword_overlap("k", "text"), 6).alias("overlap"))


@query()
def fn_normalize_answer(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", T.normalize_answer("text").alias("answer"))


@query()
def fn_token_f1(spark, sf_dir):
    b = view(spark, sf_dir, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(n, "item_id").select("item_id", F.round(T.token_f1("text", "other"), 6).alias("f1"))


@query("SELECT n_nationkey AS k, r_regionkey AS r, levenshtein(n_name, r_name) AS d FROM nation, region")
def fn_edit_distance(spark, sf_dir):
    n, r = view(spark, sf_dir, "nation"), view(spark, sf_dir, "region")
    return n.join(r).select(F.col("n_nationkey").alias("k"), F.col("r_regionkey").alias("r"), F.levenshtein("n_name", "r_name").alias("d"))


_OFF = "abs(a - d)"


@query(f"WITH x AS (SELECT event_id, user_id % 60 AS a, 7 AS d, 3.0e0 AS t FROM events) SELECT event_id, round(CASE WHEN {_OFF} <= t THEN 0.4e0 WHEN {_OFF} <= 3 * t THEN 0.4e0 * (1 - ({_OFF} - t) / (2 * t)) ELSE 0 END, 6) AS boost FROM x")
def fn_temporal_boost(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", F.round(T.temporal_boost(F.col("user_id") % 60, F.lit(7), F.lit(3)), 6).alias("boost"))


@query("""
WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('What happened ', user_id % 9 + 1, ' weeks ago?') WHEN 1 THEN 'Remind me of last month' WHEN 2 THEN concat(user_id % 5 + 2, ' days ago we met') ELSE 'no time at all' END AS q, user_id AS u FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (u % 9 + 1) * 7 WHEN 1 THEN 30 WHEN 2 THEN u % 5 + 2 END AS days, CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 2 END AS tolerance FROM x""")
def fn_relative_dates(spark, sf_dir):
    u = F.col("user_id")
    q = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("What happened "), u % 9 + 1, F.lit(" weeks ago?"))).when(F.col("event_id") % 4 == 1, F.lit("Remind me of last month"))
        .when(F.col("event_id") % 4 == 2, F.concat(u % 5 + 2, F.lit(" days ago we met"))).otherwise("no time at all")
    )
    return view(spark, sf_dir, "events").select("event_id", T.relative_days(q).alias("r")).select("event_id", F.col("r.days").cast("long").alias("days"), F.col("r.tolerance").alias("tolerance"))


@query("SELECT item_id, concat(trim(text[:60]), ' -- ', concat('because of item ', item_id, ' and so on'), CASE WHEN item_id % 2 = 0 THEN '; tests' ELSE '' END) AS summary FROM benchmark")
def fn_summary_text(spark, sf_dir):
    why = F.concat(F.lit("because of item "), "item_id", F.lit(" and so on"))
    return view(spark, sf_dir, "benchmark").select("item_id", T.summary_text(F.substring("text", 1, 60), why, F.when(F.col("item_id") % 2 == 0, "tests")).alias("summary"))


# ---- ingest ----


@query("""
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('> ', replace(text, chr(10), ' '), CASE WHEN coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'user') = 'user' THEN chr(10) ELSE '' END) ELSE concat(text, chr(10)) END AS line FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, concat(trim(string_agg(line, chr(10) ORDER BY turn), concat(chr(10), ' ')), chr(10)) AS transcript FROM m GROUP BY conv_id""")
def ingest_transcripts(spark, sf_dir):
    return files.transcripts(view(spark, sf_dir, "conversations"))


@query("SELECT id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT CAST(conv_id AS STRING) AS id, turn, text FROM conversations) AS x GROUP BY id")
def ingest_corpus(spark, sf_dir):
    return rankers.corpus(view(spark, sf_dir, "conversations"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, trim(text, concat(' ', chr(10), chr(9), chr(13))) AS t FROM documents),
step AS (
  SELECT doc_id, t, 0 AS s, CASE WHEN length(t) > 800 THEN (WITH w AS (SELECT instr(reverse(t[1:800]), concat(chr(10), chr(10))) AS p2, instr(reverse(t[1:800]), chr(10)) AS p1) SELECT CASE WHEN p2 > 0 AND 800 - p2 - 1 > 400 THEN 800 - p2 - 1 WHEN p1 > 0 AND 800 - p1 > 400 THEN 800 - p1 ELSE 800 END FROM w) ELSE length(t) END AS e FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, e - 100, CASE WHEN e + 700 < length(t) THEN (WITH w AS (SELECT instr(reverse(t[e - 99:e + 700]), concat(chr(10), chr(10))) AS p2, instr(reverse(t[e - 99:e + 700]), chr(10)) AS p1) SELECT CASE WHEN p2 > 0 AND 800 - p2 - 1 > 400 THEN e - 100 + 800 - p2 - 1 WHEN p1 > 0 AND 800 - p1 > 400 THEN e - 100 + 800 - p1 ELSE e + 700 END FROM w) ELSE length(t) END FROM step WHERE e < length(t)
), c AS (SELECT doc_id, s, trim(t[s + 1:e], concat(' ', chr(10), chr(9), chr(13))) AS content FROM step)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, content FROM c WHERE length(content) >= 50""")
def ingest_chunks(spark, sf_dir):
    return files.chunks(view(spark, sf_dir, "documents"))


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), g AS (SELECT doc_id, CASE WHEN len(l) > 21 THEN list_transform(range(0, (len(l) - 1) // 25 + 1), lambda k: trim(array_to_string(l[k * 25 + 1:k * 25 + 25], chr(10)), concat(' ', chr(10), chr(9), chr(13)))) ELSE [trim(array_to_string(l, chr(10)), concat(' ', chr(10), chr(9), chr(13)))] END AS p FROM d),
f AS (SELECT doc_id, list_filter(p, lambda x: length(x) > 30) AS p FROM g) SELECT doc_id, CAST(unnest(range(0, len(p))) AS INT) AS chunk_index, unnest(p) AS content FROM f""")
def ingest_paragraphs(spark, sf_dir):
    return files.paragraphs(view(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH t AS (SELECT user_id, string_agg(CASE WHEN event_type = 'click' THEN concat('> question ', event_id, ' about the thing') WHEN event_type = 'error' THEN '---' ELSE concat('answer ', event_id) END, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id),
l AS (SELECT user_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM t WHERE len(regexp_extract_all(text, '>')) >= 3),
q AS (SELECT *, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS q FROM l),
c AS (SELECT *, max(CASE WHEN line LIKE '---%' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, q ORDER BY pos) AS cut FROM q WHERE q > 0), p AS (SELECT user_id, q, list(line ORDER BY pos) AS parts FROM c WHERE cut = 0 GROUP BY user_id, q),
x AS (SELECT user_id, q, concat(parts[1], CASE WHEN len(parts) > 1 THEN concat(chr(10), array_to_string(parts[2:9], ' ')) ELSE '' END) AS content FROM p)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY q) - 1 AS INT) AS chunk_index, content FROM x WHERE length(content) > 30""")
def ingest_exchanges(spark, sf_dir):
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("> question "), "event_id", F.lit(" about the thing"))).when(F.col("event_type") == "error", F.lit("---")).otherwise(F.concat(F.lit("answer "), "event_id"))
    e = view(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return files.exchanges(e, "user_id", "text")


@query()
def entity_candidates(spark, sf_dir):
    return entities.candidates(view(spark, sf_dir, "documents")).where("lower(name) NOT IN ('the', 'and')")


@query()
def entity_classification(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    c = entities.candidates(d, ["the", "and"]).join(entities.prepared(d.select("doc_id", "text")), "doc_id")
    return entities.capped(entities.classify(entities.scores(c)), ["doc_id"]).select("doc_id", "name", "frequency", "person_score", "project_score", "type", "confidence")


@query("WITH r AS (SELECT lower(n_name) AS k, n_name AS canonical FROM nation) SELECT x.name, CASE WHEN r.k IS NULL THEN 'unknown' ELSE 'place' END AS type, r.canonical FROM (SELECT upper(n_name) AS name FROM nation UNION ALL SELECT r_name FROM region) AS x LEFT JOIN r ON r.k = lower(x.name)")
def entity_registry_lookup(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    names = n.select(F.upper("n_name").alias("name")).unionByName(view(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return entities.lookup(names, n.select(F.col("n_name").alias("name"), F.lit("place").alias("type"), F.lit(None).cast("array<string>").alias("aliases")))


@query("SELECT source AS source_file, lang AS content_type, count(*) AS n FROM documents GROUP BY source, lang")
def ingest_status(spark, sf_dir):
    return view(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_file"), F.col("lang").alias("content_type")).agg(F.count("*").alias("n"))


@query("SELECT source AS source_file, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 5")
def dedup_source_groups(spark, sf_dir):
    return dedup.source_groups(view(spark, sf_dir, "documents").withColumnRenamed("source", "source_file"))


@query("WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS groups, CAST(coalesce(sum(floor(0.4 * n)) FILTER (WHERE n > 20), 0) AS BIGINT) AS may_save FROM g")
def dedup_savings(spark, sf_dir):
    return dedup.savings(view(spark, sf_dir, "documents").withColumnRenamed("source", "source_file"))


@query()
def dedup_greedy(spark, sf_dir):
    """Vectors in groups of their label, with planted near copies."""
    v = view(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("source_file"), F.col("vec_id").alias("id"), F.lit("a text of a fixed length, long enough").alias("text"), "embedding")
    near = v.where("id % 10 = 0").select("source_file", (F.col("id") + 1_000_000).alias("id"), "text", "embedding")
    return dedup.dedup_sources(v.unionByName(near))


@query()
def cluster_leaders(spark, sf_dir):
    v = view(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("domain"), F.col("vec_id").alias("id"), "embedding")
    return dedup.leader_clusters(v, 0.3)


# ---- state and queues ----

_REV = "rev AS (SELECT concat('r', event_id) AS rev_id, concat('e', user_id) AS entity_id, CASE WHEN event_id % 3 = 0 THEN 'intent_state' ELSE 'project_state' END AS schema_id, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS payload, CAST(ts AS STRING) AS created_at, event_id, concat('s', event_id % 4) AS session_id FROM events)"


def _revisions(spark, sf_dir):
    return view(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("rev_id"), F.concat(F.lit("e"), "user_id").alias("entity_id"),
        F.when(F.col("event_id") % 3 == 0, "intent_state").otherwise("project_state").alias("schema_id"), F.when(F.col("event_type") != "error", F.col("props")).alias("payload"),
        F.col("ts").alias("created_at"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("session_id"),
    )


@query(f"WITH {_REV}, x AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, event_id DESC) AS r FROM rev) SELECT entity_id, schema_id, payload, session_id FROM x WHERE r = 1 AND payload IS NOT NULL")
def state_latest(spark, sf_dir):
    return state.latest_state(_revisions(spark, sf_dir)).select("entity_id", "schema_id", "payload", "session_id")


@query(f"""WITH {_REV}, a AS (SELECT *, first_value(schema_id) OVER (PARTITION BY entity_id ORDER BY created_at DESC, event_id DESC) AS last_schema FROM rev), b AS (SELECT * FROM a WHERE last_schema <> 'intent_state' OR session_id = 's1'),
x AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, event_id DESC) AS r FROM b) SELECT entity_id, schema_id, payload, session_id FROM x WHERE r = 1 AND payload IS NOT NULL""")
def state_latest_in_session(spark, sf_dir):
    scopes = spark.sql("SELECT * FROM VALUES ('intent_state', 'session'), ('project_state', 'global') AS t(schema_id, scope)")
    return state.latest_state(_revisions(spark, sf_dir), scopes, "s1").select("entity_id", "schema_id", "payload", "session_id")


@query("SELECT id, subject, predicate, object, CASE WHEN valid_to IS NULL AND predicate = 'placed_by' AND object IN (SELECT concat('customer_', c_custkey) FROM customer WHERE c_custkey % 10 = 0) THEN '2024-01-01' ELSE valid_to END AS valid_to FROM triples")
def state_invalidate(spark, sf_dir):
    t = view(spark, sf_dir, "triples")
    c = view(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("object"))
    closed = t.where("predicate = 'placed_by'").join(c, "object", "left_semi").select("subject", "predicate", "object", F.lit("2024-01-01").alias("ended"))
    return state.invalidate(t, closed).select("id", "subject", "predicate", "object", "valid_to")


_GONE = "SELECT concat('customer_', c_custkey) FROM customer WHERE c_custkey % 10 = 0"


@query(f"SELECT id, CASE WHEN valid_to IS NULL AND (subject IN ({_GONE}) OR object IN ({_GONE})) THEN '2024-01-01' ELSE valid_to END AS valid_to FROM triples")
def state_soft_delete(spark, sf_dir):
    ids = view(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"))
    return state.soft_delete(view(spark, sf_dir, "entities"), view(spark, sf_dir, "triples"), ids, "2024-01-01")[1].select("id", "valid_to")


_INTO = "m AS (SELECT concat('nation_', n_nationkey) AS s, concat('nation_', n_regionkey) AS t FROM nation WHERE n_nationkey >= 5)"


@query(f"WITH {_INTO}, x AS (SELECT tr.id, coalesce(a.t, tr.subject) AS subject, tr.predicate, coalesce(b.t, tr.object) AS object, tr.valid_from, tr.valid_to FROM triples AS tr LEFT JOIN m AS a ON a.s = tr.subject LEFT JOIN m AS b ON b.s = tr.object), r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object, valid_from, valid_to ORDER BY id) AS k FROM x) SELECT id, subject, predicate, object FROM r WHERE k = 1")
def state_merge_entities(spark, sf_dir):
    m = view(spark, sf_dir, "nation").where("n_nationkey >= 5").select(F.concat(F.lit("nation_"), "n_nationkey").alias("source"), F.concat(F.lit("nation_"), "n_regionkey").alias("target"))
    return state.merge_entities(view(spark, sf_dir, "entities"), view(spark, sf_dir, "triples"), m)[1].select("id", "subject", "predicate", "object")


_NEW = "SELECT concat('n_', o_orderkey) AS id, concat('customer_', o_custkey) AS subject, 'likes' AS predicate, concat('nation_', o_orderkey % 30) AS object, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'likes it' END AS statement FROM orders"


@query(f"WITH n AS ({_NEW}), act AS (SELECT id FROM entities WHERE status = 'active'), ok AS (SELECT * FROM n WHERE statement IS NOT NULL AND subject IN (SELECT id FROM act) AND object IN (SELECT id FROM act)), r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY id) AS k FROM ok) SELECT id, subject, predicate, object FROM r WHERE k = 1")
def state_add_triples(spark, sf_dir):
    view(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    new = spark.sql(_NEW)
    return state.add_triples(view(spark, sf_dir, "triples"), new, view(spark, sf_dir, "entities"), ["is_a"]).select("id", "subject", "predicate", "object")


@query("""
WITH ev AS (SELECT least(a, b) AS f, greatest(a, b) AS t, max(w) AS w, ctx FROM (SELECT concat('customer_', user_id % 20) AS a, concat('nation_', event_id % 25) AS b, value AS w, CAST(event_id % 7 AS STRING) AS ctx FROM events) AS x GROUP BY 1, 2, ctx),
ed AS (SELECT DISTINCT least(subject, object) AS f, greatest(subject, object) AS t FROM triples WHERE valid_to IS NULL OR valid_to = '')
SELECT f AS from_entity, t AS to_entity, round(sum(w), 4) AS score, count(*) AS shared_context_count FROM ev WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.f = ev.f AND ed.t = ev.t) GROUP BY f, t""")
def queue_link_candidates(spark, sf_dir):
    e = view(spark, sf_dir, "events").select(F.concat(F.lit("customer_"), F.col("user_id") % 20).alias("a"), F.concat(F.lit("nation_"), F.col("event_id") % 25).alias("b"), F.col("value").alias("w"), (F.col("event_id") % 7).cast("string").alias("ctx"))
    return state.upsert_candidates(e, view(spark, sf_dir, "triples")).withColumn("score", F.round("score", 4))


@query("WITH l AS (SELECT event_type AS conflict_type, concat('a', user_id) AS existing_id, concat('b', event_id % 10) AS new_id, event_id AS conflict_id, CASE WHEN event_id % 2 = 0 THEN 'keep' ELSE 'merge' END AS action, ts AS created_at FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY existing_id, new_id, conflict_type ORDER BY created_at DESC, conflict_id DESC) AS r FROM l) SELECT existing_id, new_id, conflict_type, action, conflict_id FROM x WHERE r = 1")
def queue_latest_resolution(spark, sf_dir):
    l = view(spark, sf_dir, "events").select(F.col("event_type").alias("conflict_type"), F.concat(F.lit("a"), "user_id").alias("existing_id"), F.concat(F.lit("b"), F.col("event_id") % 10).alias("new_id"), F.col("event_id").alias("conflict_id"), F.when(F.col("event_id") % 2 == 0, "keep").otherwise("merge").alias("action"), F.col("ts").alias("created_at"))
    return state.latest_resolution(l).select("existing_id", "new_id", "conflict_type", "action", "conflict_id")


@query("WITH a AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'keep' ELSE 'drop' END AS action, CASE WHEN event_id % 3 = 0 THEN 'short' ELSE concat('a reason for case ', event_id // 4) END AS reason FROM events) SELECT event_id, action = 'keep' AND length(reason) >= 15 AND count(*) OVER (PARTITION BY reason) < 3 AS accepted FROM a")
def queue_check_resolutions(spark, sf_dir):
    e = F.col("event_id")
    a = view(spark, sf_dir, "events").select("event_id", F.when(e % 2 == 0, "keep").otherwise("drop").alias("action"), F.when(e % 3 == 0, F.lit("short")).otherwise(F.concat(F.lit("a reason for case "), F.floor(e / 4))).alias("reason"))
    return state.check_resolutions(a).select("event_id", "accepted")


@query("WITH x AS (SELECT event_type AS kind, array_to_string(list_sort([concat('m', user_id), concat('m', event_id % 5)]), '|') AS memory_key, concat('c', event_id % 3) AS context_id, ts FROM events) SELECT kind, memory_key, context_id, count(*) - 1 AS attempted_count FROM x GROUP BY kind, memory_key, context_id")
def queue_record_flags(spark, sf_dir):
    f = view(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.array(F.concat(F.lit("m"), "user_id"), F.concat(F.lit("m"), F.col("event_id") % 5)).alias("memory_ids"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("context_id"), F.col("ts").cast("string").alias("ts"))
    none = spark.createDataFrame([], "kind string, memory_key string, context_id string, attempted_count int, last_attempt_ts string")
    created = spark.sql("SELECT 'm999999' AS id, '2024-01-31 00:00:00' AS created_at")
    return state.record_flags(none, f, created, "2024-01-31 00:10:00").drop("last_attempt_ts")


@query("WITH m AS (SELECT concat('part_', p_partkey) AS o, concat('item_', p_partkey) AS n FROM part WHERE p_partkey % 2 = 0) SELECT t.id, coalesce(m.n, t.object) AS object FROM triples AS t LEFT JOIN m ON m.o = t.object")
def state_remap_ids(spark, sf_dir):
    m = view(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part_"), "p_partkey").alias("old"), F.concat(F.lit("item_"), "p_partkey").alias("new"))
    return state.remap_ids(view(spark, sf_dir, "triples").select("id", "object"), "object", m)


@query("SELECT o_orderkey, concat('rec_', 100 + row_number() OVER (ORDER BY o_orderkey)) AS new_id FROM orders")
def state_renumber(spark, sf_dir):
    return state.renumber(view(spark, sf_dir, "orders").select("o_orderkey"), "rec", ["o_orderkey"], 100)


@query("SELECT event_type AS type, count(*) FILTER (WHERE value > 50) AS good, round(avg(value), 4) AS mean_score, count(*) AS runs FROM events GROUP BY event_type HAVING count(*) FILTER (WHERE value > 50) >= 3")
def state_promotion_candidates(spark, sf_dir):
    r = view(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("value").alias("score"))
    return state.promotion_candidates(r, 50.0).withColumn("mean_score", F.round("mean_score", 4))


# ---- streams: batch twins with SQL, and the streams themselves ----


@query("WITH x AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('click', 'view')) SELECT user_id AS session, nth, ts FROM x WHERE nth % 15 = 0")
def stream_count_trigger(spark, sf_dir):
    return ops.count_trigger_batch(view(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts"))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest_by_key(spark, sf_dir):
    return ops.latest_by_key(view(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")


@query("SELECT date_trunc('day', ts) AS start, count(*) AS calls, round(avg(CASE WHEN reused THEN 1.0e0 ELSE 0.0e0 END), 4) AS reuse_rate FROM telemetry GROUP BY 1")
def stream_tumbling_reuse(spark, sf_dir):
    return ops.tumbling_reuse(view(spark, sf_dir, "telemetry"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def stream_sessions_extension(spark, sf_dir):
    return ops.sessions(view(spark, sf_dir, "events"), "2 hours")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY")
def stream_prune_expired(spark, sf_dir):
    return ops.prune_expired(view(spark, sf_dir, "events").select("event_id", F.col("ts").alias("cue_ts")), "2024-01-30", "2 days").withColumnRenamed("cue_ts", "ts")


# ---- benchmark rankers ----


@query()
def rank_benchmark_hybrid(spark, sf_dir):
    """Benchmark texts as questions against all documents, distances from the hashing embedder."""
    from tessera.operators.vector import cosine_top_k, hashing_embedder

    embed = hashing_embedder()
    q = view(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    d = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = cosine_top_k(q.select("query_id", F.lit(0).alias("view"), embed("question").alias("query")), d.select("id", embed("text").alias("embedding")), 50)
    hits = hits.join(d, "id").select("query_id", "id", (1 - F.col("similarity")).alias("distance"), "text", (F.col("id") % 30).alias("age"))
    return rankers.rerank(hits, rankers.question_features(q))


@query("SELECT conv_id, bool_or(contains(lower(a), lower(b)) OR contains(lower(b), lower(a))) AS found FROM (SELECT conv_id, text AS a, substring(text, 3, 8 + turn % 3) AS b FROM conversations) AS x GROUP BY conv_id")
def metric_evidence_found(spark, sf_dir):
    r = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("retrieved"), F.substr("text", F.lit(3), 8 + F.col("turn").cast("int") % 3).alias("evidence"))
    return rankers.evidence_found(r).withColumnRenamed("query_id", "conv_id")


@query("WITH x AS (SELECT user_id AS query_id, list(DISTINCT event_id % 13 ORDER BY event_id % 13) FILTER (WHERE event_type = 'view') AS r, list(DISTINCT event_id % 13 ORDER BY event_id % 13) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY user_id), y AS (SELECT query_id, len(list_intersect(coalesce(r, []), coalesce(e, []))) AS h, len(coalesce(e, [])) AS n FROM x) SELECT query_id, round(CASE WHEN n = 0 THEN 1 ELSE h / n::DOUBLE END, 6) AS recall, CASE WHEN n = 0 OR h > 0 THEN 1.0e0 ELSE 0.0e0 END AS recall_any, CASE WHEN h = n THEN 1.0e0 ELSE 0.0e0 END AS recall_all FROM y")
def metric_retrieval_recall(spark, sf_dir):
    from tessera.operators.metrics import retrieval_recall

    k = F.col("event_id") % 13
    x = view(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.collect_set(F.when(F.col("event_type") == "view", k)).alias("retrieved"), F.collect_set(F.when(F.col("event_type") == "error", k)).alias("evidence"))
    return retrieval_recall(x).withColumn("recall", F.round("recall", 6))
