"""Views of the driver's tables in the engine's schemas, as SQL that Spark and DuckDB both run.

``tables`` registers the Parquet files as temporary views; ``view`` builds one view as a DataFrame, and
``with_views`` the same views as common table expressions for a SQL twin.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "entities": """
        SELECT concat('region_', r_regionkey) AS id, r_name AS name, 'class' AS kind, 5 AS importance, '2024-01-01' AS last_touched, 'active' AS status FROM region
        UNION ALL SELECT concat('nation_', n_nationkey), n_name, 'entity', 4, '2024-01-02', 'active' FROM nation
        UNION ALL SELECT concat('customer_', c_custkey), c_name, 'entity', 3, concat('2023-0', 1 + c_custkey % 9, '-15'), CASE WHEN c_custkey % 50 = 7 THEN 'deleted' ELSE 'active' END FROM customer
        UNION ALL SELECT concat('supplier_', s_suppkey), s_name, 'entity', 3, '2024-02-01', 'active' FROM supplier
        UNION ALL SELECT concat('part_', p_partkey), p_name, 'literal', 2, '2024-03-01', 'active' FROM part
        UNION ALL SELECT concat('order_', o_orderkey), concat('Order ', o_orderkey), 'record', 1, CAST(CAST(o_orderdate AS DATE) AS STRING), 'active' FROM orders""",
    "triples": """
        SELECT concat('t_nation_', n_nationkey) AS id, concat('nation_', n_nationkey) AS subject, 'is_a' AS predicate, concat('region_', n_regionkey) AS object, CAST(NULL AS STRING) AS valid_from, CAST(NULL AS STRING) AS valid_to, 1.0e0 AS confidence, CAST(NULL AS STRING) AS statement, 'ctx_0' AS creation_context_id FROM nation
        UNION ALL SELECT concat('t_customer_', c_custkey), concat('customer_', c_custkey), 'located_in', concat('nation_', c_nationkey), CAST(NULL AS STRING), CAST(NULL AS STRING), 0.9e0, concat(c_name, ' is located there'), concat('ctx_', c_custkey % 20) FROM customer
        UNION ALL SELECT concat('t_supplier_', s_suppkey), concat('supplier_', s_suppkey), 'located_in', concat('nation_', s_nationkey), CAST(NULL AS STRING), CAST(NULL AS STRING), 0.8e0, CAST(NULL AS STRING), 'ctx_1' FROM supplier
        UNION ALL SELECT concat('t_order_', o_orderkey), concat('order_', o_orderkey), 'placed_by', concat('customer_', o_custkey), CAST(CAST(o_orderdate AS DATE) AS STRING), CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(last_ship AS DATE) AS STRING) END, 0.7e0, CAST(NULL AS STRING), concat('ctx_', o_orderkey % 50)
          FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) AS shipped ON o_orderkey = l_orderkey
        UNION ALL SELECT concat('t_supplies_', l_suppkey, '_', l_partkey), concat('supplier_', l_suppkey), 'supplies', concat('part_', l_partkey), CAST(CAST(min(l_shipdate) AS DATE) AS STRING), CAST(CAST(max(l_shipdate) AS DATE) AS STRING), 0.6e0, CAST(NULL AS STRING), 'ctx_2' FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "aliases": """
        SELECT concat('cust_', c_custkey) AS alias, concat('customer_', c_custkey) AS canonical_id FROM customer""",
    "vectors": """
        SELECT vec_id, embedding, label FROM embeddings""",
    "ratings": """
        SELECT d.source AS context_id, concat('doc_', l.doc_id) AS memory_id, l.doc_id AS seq, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 5 WHEN l.quality = 1 THEN 3 WHEN l.toxic = 0 THEN 2 ELSE 1 END AS relevance,
               concat('2024-01-', CASE WHEN l.doc_id % 28 < 9 THEN '0' ELSE '' END, l.doc_id % 28 + 1) AS ts, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS label, d.n_chars
        FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id""",
    "event_messages": """
        SELECT event_id, user_id, event_type, CASE event_type
            WHEN 'error' THEN concat('The bug in job ', user_id, ' is broken again and the error keeps crashing. The problem is the config.')
            WHEN 'purchase' THEN concat('We decided to go with plan ', user_id, ' because it is cheaper. Let us use it instead of the old one.')
            WHEN 'signup' THEN concat('I prefer to always use dark mode for account ', user_id, ' and I like short answers.')
            WHEN 'click' THEN concat('It finally works! We shipped build ', user_id, ' and figured out the fix. Great, I am so happy.')
            ELSE concat('Page ', user_id, ' was viewed.') END AS text
        FROM events""",
    "telemetry": """
        SELECT event_id, ts, user_id, event_type AS tool, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 2 = 0 AS reused FROM events""",
}


def needed(text: str, among) -> list[str]:
    """Names of ``among`` that a SQL text mentions."""
    return [n for n in among if re.search(rf"\b{n}\b", text)]


def tables(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in needed(text, TABLES):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a table by its name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables(spark, sf_dir, VIEWS[name])
    return spark.sql(VIEWS[name])


def with_views(text: str) -> str:
    """``text`` with the views it mentions in front, for a SQL twin."""
    names = needed(text, VIEWS)
    if not names:
        return text
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = text.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
