"""Queries of filters, the vector index and search over channels, each with its SQL twin where results are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.filters import filtered
from tessera.functions.scoring import CHANNEL_WEIGHTS
from tessera.operators import index, keywords, ranking, search
from tessera.plans.fixtures import view, with_views
from tessera.plans.rank_queries import _M, _Q, _TOP, _multi, _queries, _vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


# ---- filters ----

_TREE = {"$and": [{"lang": {"$in": ["en", "de", None]}}, {"$or": [{"n_chars": {"$lt": 500}}, {"text": {"$contains": "the"}}]}], "doc_id": {"$gte": 10, "$ne": 17}, "$not": {"source": None}}


@query("SELECT doc_id FROM documents WHERE (lang IN ('en', 'de') OR lang IS NULL) AND (n_chars < 500 OR contains(text, 'the')) AND doc_id >= 10 AND doc_id <> 17 AND source IS NOT NULL")
def filter_documents(spark, sf_dir):
    return filtered(view(spark, sf_dir, "documents"), _TREE).select("doc_id")


def _labelled(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", F.floor(F.col("vec_id") / 4).alias("owner_id"))


@query(f"WITH {_Q}, s2 AS (SELECT s.* FROM s JOIN embeddings AS e ON e.vec_id = s.id WHERE e.label IN (1, 3, 5) AND s.id >= 100), r AS ({_TOP.replace('FROM s', 'FROM s2')}) SELECT query_id, view, id, similarity, rank FROM r WHERE rank <= 10")
def vec_filtered_top_k(spark, sf_dir):
    return search.filtered_top_k(_queries(spark, sf_dir), _labelled(spark, sf_dir), {"label": {"$in": [1, 3, 5]}, "id": {"$gte": 100}}, 10)


@query(f"WITH {_Q}, s2 AS (SELECT s.* FROM s JOIN embeddings AS e ON e.vec_id = s.id WHERE CASE s.query_id // 50 % 3 WHEN 0 THEN e.label = 2 WHEN 1 THEN e.label > 6 AND s.id % 1 = 0 ELSE true END), r AS ({_TOP.replace('FROM s', 'FROM s2')}) SELECT query_id, view, id, similarity, rank FROM r WHERE rank <= 5")
def vec_top_k_by_filter(spark, sf_dir):
    """Every query with a filter of its own."""
    turn = F.floor(F.col("query_id") / 50) % 3
    own = F.when(turn == 0, '{"label": 2}').when(turn == 1, '{"label": {"$gt": 6}}')
    return search.top_k_by_filter(_queries(spark, sf_dir).withColumn("filter", own), _labelled(spark, sf_dir), 5)


# ---- index ----


@query()
def vec_index_search(spark, sf_dir):
    """Nearest ten by the index, in as many lists as its sample says; tests hold its recall."""
    return index.search(index.build(_vectors(spark, sf_dir).select("id", "embedding")), _queries(spark, sf_dir), 10)


@query(f"WITH {_Q}, s2 AS (SELECT * FROM s WHERE id <> query_id), r AS ({_TOP.replace('FROM s', 'FROM s2')}) SELECT query_id, view, id, similarity, rank FROM r WHERE rank <= 10")
def vec_index_all_lists(spark, sf_dir):
    """The index where a query visits all lists and leaves itself out: the exact neighbours."""
    q = _queries(spark, sf_dir)
    made = index.build(_vectors(spark, sf_dir).select("id", "embedding"))
    return index.search(made, q, 10, len(made.centroids.points), q.select("query_id", F.col("query_id").alias("id")))


# ---- channels ----

_W = {k: f"{v}e0" for k, v in CHANNEL_WEIGHTS.items()}
_CHANNELS = f"""{_M}, ok AS (SELECT DISTINCT concat('part_', vec_id // 4) AS id FROM embeddings WHERE label <> 4),
s4 AS (SELECT s.* FROM s JOIN embeddings AS e ON e.vec_id = s.id WHERE e.label <> 4), hit AS (SELECT * FROM ({_TOP.replace('FROM s', 'FROM s4')}) AS h WHERE rank <= 50),
cos AS (SELECT query_id, view, concat('part_', owner_id) AS id, round(max(similarity), 3) AS similarity FROM hit GROUP BY query_id, view, owner_id),
post AS (SELECT DISTINCT concat('part_', p_partkey) AS entity_id, w AS keyword FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]{{3,8}}')) AS w FROM part) AS x),
np AS (SELECT count(*) AS n FROM part), idf AS (SELECT keyword, round(ln(greatest(0, (any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) + 1), 6) AS idf FROM post, np GROUP BY keyword),
ask AS (SELECT DISTINCT v.id AS query_id, p.keyword FROM v JOIN post AS p ON p.entity_id = concat('part_', v.id) WHERE v.id % 50 = 0),
aw AS (SELECT *, max(coalesce(idf, 0)) OVER (PARTITION BY query_id) <= 0 AS cold FROM ask LEFT JOIN idf USING (keyword)),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY entity_id) AS r FROM post) AS x WHERE r <= 50),
kw AS (SELECT query_id, entity_id AS id, sum(CASE WHEN cold THEN 1 ELSE idf END) AS score FROM aw JOIN lim USING (keyword) WHERE cold OR idf >= 0 GROUP BY query_id, entity_id),
known AS (SELECT query_id, id, max(similarity) AS similarity FROM cos GROUP BY query_id, id),
seed AS (SELECT DISTINCT c.query_id, c.id, k.similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, view ORDER BY similarity DESC, id) AS r FROM cos) AS c JOIN known AS k ON k.query_id = c.query_id AND k.id = c.id WHERE r <= 3),
cur AS (SELECT subject, object FROM triples WHERE valid_to IS NULL OR valid_to = '' OR predicate = 'supplies'),
ways AS (SELECT subject AS near, object AS far FROM cur UNION ALL SELECT object, subject FROM cur),
deg AS (SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM cur UNION ALL SELECT object FROM cur) AS x GROUP BY id),
one AS (SELECT query_id, far, max(greatest(0.2e0, 0.8e0 * similarity)) AS base FROM seed JOIN ways ON near = id WHERE far <> id GROUP BY query_id, far),
gr AS (SELECT query_id, far AS id, base / ln(degree + 2) AS score FROM one JOIN deg ON deg.id = far),
ctx AS (SELECT context_id, row_number() OVER (ORDER BY context_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT context_id FROM ratings) AS x),
near AS (SELECT v.id AS query_id, context_id FROM v JOIN ctx ON v.id // 50 % n = k WHERE v.id % 50 = 0),
cx AS (SELECT query_id, concat('part_', seq) AS id, round(sum(CASE WHEN relevance >= 3 THEN 1 ELSE -1 END * CASE relevance WHEN 1 THEN 1.0e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.2e0 WHEN 4 THEN 0.8e0 ELSE 1.0e0 END), 9) AS score FROM near JOIN ratings USING (context_id) GROUP BY query_id, seq),
lists AS (SELECT query_id, concat('cosine_', view) AS list_name, {_W['cosine']} AS weight, id, similarity AS score FROM cos UNION ALL SELECT query_id, 'keyword', {_W['keyword']}, id, score FROM kw WHERE id IN (SELECT id FROM ok)
  UNION ALL SELECT query_id, 'graph', {_W['graph']}, id, score FROM gr WHERE id IN (SELECT id FROM ok) UNION ALL SELECT query_id, 'context', {_W['context']}, id, score FROM cx WHERE score > 0 AND id IN (SELECT id FROM ok)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_name ORDER BY round(score, 9) DESC, id) AS r FROM lists)"""


@query(f"WITH {_CHANNELS} SELECT query_id, id, round(sum(weight / (60 + r)), 9) AS rrf, string_agg(DISTINCT split_part(list_name, '_', 1), ',' ORDER BY split_part(list_name, '_', 1)) AS channels, min(list_name) AS primary_list FROM rk GROUP BY query_id, id")
def rank_multi_channel(spark, sf_dir):
    """Two views, words of a part's name, current facts from the hits, ratings of a context, and a filter on all of them."""
    from tessera.operators.feedback import record_feedback

    q = _multi(spark, sf_dir)
    p = view(spark, sf_dir, "part")
    words = p.select(F.concat(F.lit("part_"), "p_partkey").alias("entity_id"), F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]{3,8}"), F.lit(0))).alias("keywords"))
    posts = words.select("entity_id", F.explode("keywords").alias("keyword"))
    idfs = keywords.keyword_idf(words, p.select(F.concat(F.lit("part_"), "p_partkey").alias("id"), F.lit("active").alias("status")))
    owner = F.concat(F.lit("part_"), F.floor(F.col("vec_id") / 4))
    vectors = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", owner.alias("owner_id"))
    asked = q.select("query_id", F.concat(F.lit("part_"), "query_id").alias("entity_id")).distinct().join(posts, "entity_id").select("query_id", "keyword")
    t = view(spark, sf_dir, "triples")
    t = t.withColumn("valid_to", F.when(F.col("predicate") != "supplies", F.col("valid_to")))  # supplies holds on
    r = view(spark, sf_dir, "ratings")
    contexts = r.select("context_id").distinct()
    n = contexts.count()
    from pyspark.sql import Window

    numbered = contexts.withColumn("k", F.row_number().over(Window.orderBy("context_id")) - 1)  # a few sources
    near = q.select("query_id").distinct().withColumn("k", F.floor(F.col("query_id") / 50) % n).join(numbered, "k").select("query_id", "context_id", F.lit(1.0).alias("weight"))
    rated = record_feedback(r.withColumn("memory_id", F.concat(F.lit("part_"), "seq")))
    found = search.multi_channel_search(q, vectors, tree={"label": {"$ne": 4}}, asked=asked, postings=posts, idfs=idfs, triples=t, neighbours=near, ratings=rated)
    found = found.withColumn("score", F.round("score", 9))
    return ranking.rrf(found).withColumn("rrf", F.round("rrf", 9)).withColumnRenamed("primary", "primary_list")


_PREVIEW = "CASE WHEN length(t) > 160 THEN concat(rtrim(substring(t, 1, 157)), '...') ELSE t END"


@query("""
SELECT c_nationkey AS query_id, concat('t_customer_', c_custkey) AS id, 'triple' AS source, concat(c_name, ' is located there') AS text, c_custkey AS score FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_nationkey, concat('customer_', c_custkey), 'record', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END, c_custkey FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 <> 0
UNION ALL SELECT c_nationkey, concat('customer_', c_custkey), 'record', NULL, c_custkey FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 = 0""")
def search_project_hits(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    hits = c.select(
        F.col("c_nationkey").alias("query_id"), F.concat(F.when(even, "t_customer_").otherwise("customer_"), "c_custkey").alias("id"),
        F.when(even, "triple").otherwise("record").alias("source"), F.col("c_custkey").alias("score"),
    )
    records = c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("summary"), F.col("c_name").alias("content"))
    return search.project_hits(hits, records, view(spark, sf_dir, "triples"))
