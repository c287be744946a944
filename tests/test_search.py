"""Filters against a plain evaluation, the index against exact neighbours, channels by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.filters import fields, filtered, scope, where
from tessera.operators import index, search, vector

# ---- filters ----


def passes(tree, row):
    """A tree on one row by its definition."""
    def op(name, c, v):
        if name == "$ne":
            return c is not None if v is None else c is None or c != v
        if name == "$nin":
            return c not in v
        if name == "$not_contains":
            return c is None or v not in c
        if name == "$eq" and v is None:
            return c is None
        if name == "$in":
            return c in v
        if c is None:
            return False
        return {"$eq": lambda: c == v, "$gt": lambda: c > v, "$gte": lambda: c >= v, "$lt": lambda: c < v, "$lte": lambda: c <= v, "$contains": lambda: v in c}[name]()

    out = True
    for k, v in tree.items():
        if k == "$and":
            out &= all(passes(x, row) for x in v)
        elif k == "$or":
            out &= any(passes(x, row) for x in v)
        elif k == "$not":
            out &= not passes(v, row)
        else:
            out &= all(op(n, row[k], x) for n, x in (v if isinstance(v, dict) else {"$eq": v}).items())
    return out


def some_tree(r, depth=3):
    if depth and r.random() < 0.5:
        k = r.choice(["$and", "$or", "$not"])
        return {k: some_tree(r, depth - 1)} if k == "$not" else {k: [some_tree(r, depth - 1) for _ in range(r.randint(1, 3))]}
    f = r.choice(["n", "s"])
    values = [1, 2, 3, None] if f == "n" else ["a", "ab", "", None]
    real = [v for v in values if v is not None]
    name = r.choice(["", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"] + (["$contains", "$not_contains"] if f == "s" else []))
    if not name:
        return {f: r.choice(values)}
    if name in ("$in", "$nin"):
        return {f: {name: r.sample(values, r.randint(0, 3))}}
    return {f: {name: r.choice(values if name in ("$eq", "$ne") else real)}}


def test_trees_against_their_definition(spark):
    rows = [{"i": i, "n": n, "s": s} for i, (n, s) in enumerate([(n, s) for n in (None, 1, 2, 3) for s in (None, "", "a", "ab", "b")])]
    df = spark.createDataFrame([(x["i"], x["n"], x["s"]) for x in rows], "i int, n int, s string").cache()
    r = random.Random(4)
    trees = [some_tree(r) for _ in range(120)]
    got = df.select("i", *(F.coalesce(where(t), F.lit(False)).alias(f"t{k}") for k, t in enumerate(trees))).collect()
    for x, g in zip(rows, sorted(got)):
        for k, t in enumerate(trees):
            assert g[f"t{k}"] == passes(t, x), (t, x)


def test_trees_as_json_and_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert filtered(df, json.dumps({"n": {"$gt": 1}})).collect()[0].n == 2
    assert filtered(df, None).count() == filtered(df, " ").count() == filtered(df, {}).count() == 2
    assert fields({"$and": [{"a": 1}, {"$not": {"b": {"$gt": 1}}}], "c": 2}) == {"a", "b", "c"}
    for bad in ({"m": 1}, {"n": {"$near": 1}}, {"n": {}}, {"$and": []}, {"$xor": [{"n": 1}]}, "[1]"):
        with pytest.raises(ValueError):
            filtered(df, bad)
    assert scope("me", "kind") == {"added_by": "me"} and scope(None, "k") == {"kind": "k"} and scope() == {}


def test_filters_reach_the_scan(spark, sf):
    """The predicate is pushed, and what it asks of the vectors runs before they are scored."""
    q = spark.createDataFrame([(1, 0, [0.1] * 64)], "query_id long, view int, query array<double>")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    plan = search.filtered_top_k(q, v, {"$and": [{"label": {"$in": [1, 3]}}, {"id": {"$gte": 5}}]})._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.split("\n") if "PushedFilters" in x][0]
    assert "In(label, [1,3])" in pushed and "GreaterThanOrEqual(vec_id,5)" in pushed


def test_a_filter_for_each_query(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(10)], "id long, embedding array<double>, odd int")
    q = spark.createDataFrame([(1, 0, [1.0, 0.0], '{"odd": 1}'), (2, 0, [1.0, 0.0], None), (3, 0, [1.0, 0.0], '{"id": {"$gt": 100}}')], "query_id long, view int, query array<double>, filter string")
    got = [(r.query_id, r.id) for r in search.top_k_by_filter(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 3), (2, 0), (2, 1)]
    with pytest.raises(ValueError):
        search.top_k_by_filter(q, v, 2, most=2)


# ---- index ----


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + list(extra), "id long, embedding array<double>, kind int")


def recall(spark, x, k=10, **how):
    v = table(spark, x)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.lit(0).alias("view"), F.col("embedding").alias("query"))
    made = index.build(v, **how)
    found = {(r.query_id, r.id) for r in index.search(made, q, k).collect()}
    exact = {(r.query_id, r.id) for r in vector.cosine_top_k(q, v, k).collect()}
    return len(found & exact) / len(exact), made


def clustered(n, d, clusters, seed=1):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((clusters, d))
    return centers[r.integers(clusters, size=n)] + 0.35 * r.standard_normal((n, d))


@pytest.mark.parametrize("x", [clustered(3000, 32, 40), np.random.default_rng(2).standard_normal((2500, 64))], ids=["clusters", "none"])
def test_recall(spark, x):
    """At least 0.9 of the exact ten nearest, for queries of every 50th row, also where vectors have no structure."""
    share, made = recall(spark, x)
    assert share >= 0.9
    assert len(made.centroids.points) >= 40


def test_clusters_need_few_lists(spark):
    _, made = recall(spark, clustered(3000, 32, 40))
    assert made.centroids.probes <= len(made.centroids.points) / 4


def test_recall_from_a_small_sample(spark):
    """Centroids of 400 rows, all 3000 rows in the lists."""
    share, made = recall(spark, clustered(3000, 32, 40), sample=400)
    assert share >= 0.9 and made.rows.count() == 3000


def test_query_recall(spark, sf):
    """The registered query on the driver's table."""
    from tessera.plans import rank_queries, search_queries

    found = {(r.query_id, r.id) for r in search_queries.vec_index_search(spark, sf).collect()}
    exact = {(r.query_id, r.id) for r in rank_queries.vec_cosine_top_k(spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "view", "id", "similarity", "rank").collect()))


def test_all_lists_are_exact_with_parts_ties_and_odd_rows(spark, monkeypatch, tmp_path):
    """Lists cut into parts, equal vectors, a list with a third of all rows, unusable rows, saved and loaded, filtered, with exclusions."""
    monkeypatch.setattr(index, "PART", 16)
    x = np.concatenate([clustered(200, 8, 5), np.ones((100, 8))])
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 8, 0), (1003, [1.0, 2.0], 0), (1004, [1.0, None] + [0.0] * 6, 0), (1005, [math.nan] * 8, 0)]
    v = table(spark, x, odd)
    good = v.where("id < 1000")
    q = good.where("id % 7 = 0").select(F.col("id").alias("query_id"), (F.col("id") % 2).cast("int").alias("view"), F.col("embedding").alias("query"))
    q = q.unionByName(spark.createDataFrame([(5000, 0, [0.0] * 8), (5001, 0, None)], "query_id long, view int, query array<double>"))
    exact = q.where("query_id < 5000")
    made = index.build(v, lists=6)
    every = len(made.centroids.points)
    assert made.rows.count() == 300 and max(made.parts.values()) > 1
    assert rows(index.search(made, q, 4, every)) == rows(vector.cosine_top_k(exact, good, 4))
    out = exact.select("query_id", F.col("query_id").alias("id")).unionByName(exact.select("query_id", F.lit(250).cast("long").alias("id")))
    assert rows(index.search(made, q, 4, every, out)) == rows(vector.cosine_top_k(exact, good, 4, out))
    made.save(str(tmp_path / "index"))
    again = index.load(spark, str(tmp_path / "index"))
    assert again.centroids.probes == made.centroids.probes and rows(index.search(again, q, 4, every)) == rows(index.search(made, q, 4, every))
    few = index.Index(again.centroids, filtered(again.rows, {"kind": {"$ne": 1}}), again.parts)
    assert rows(index.search(few, q, 4, every)) == rows(vector.cosine_top_k(exact, good.where("kind <> 1"), 4))


def test_empty_index(spark):
    v = table(spark, np.zeros((0, 8)))
    q = spark.createDataFrame([(1, 0, [1.0] * 8)], "query_id long, view int, query array<double>")
    assert index.search(index.build(v), q).count() == 0
    one = table(spark, np.ones((1, 8)))
    assert [r.id for r in index.search(index.build(one), q).collect()] == [0]
    assert index.search(index.build(one), q.where("false")).count() == 0


# ---- channels ----


def test_channels_by_hand(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a", "note"), (2, [0.9, 0.1], "a", "note"), (3, [0.0, 1.0], "b", "note"), (4, [1.0, 0.05], "c", "task")], "id long, embedding array<double>, owner_id string, kind string")
    q = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "query_id long, view int, query array<double>")
    t = spark.createDataFrame([("t", "a", "near", "b", None, None, None), ("u", "a", "near", "c", None, None, None), ("v", "b", "near", "z", None, "2020-01-01", None)], "id string, subject string, predicate string, object string, valid_from string, valid_to string, statement string")
    own = spark.createDataFrame([(7, "c")], "query_id long, id string")
    posts = spark.createDataFrame([("a", "tea"), ("c", "tea"), ("b", "pot")], "entity_id string, keyword string")
    idfs = spark.createDataFrame([("tea", 0.5), ("pot", 2.0)], "keyword string, idf double")
    asked = spark.createDataFrame([(7, "Tea"), (7, "none")], "query_id long, keyword string")

    def lists(**how):
        out = {}
        for r in search.multi_channel_search(q, v, **how).collect():
            out.setdefault(r.list_name, {})[r.id] = round(r.score, 3)
        return out

    plain = lists()
    assert plain == {"cosine_0": {"a": 1.0, "b": 0.0, "c": 0.999}, "cosine_1": {"a": 0.11, "b": 1.0, "c": 0.05}}
    got = lists(tree={"kind": "note"}, asked=asked, postings=posts, idfs=idfs, triples=t)
    assert set(got) == {"cosine_0", "cosine_1", "keyword", "graph"}
    assert got["keyword"] == {"a": 0.5} and "c" not in got["cosine_0"] and set(got["graph"]) == {"a", "b"}
    assert set(lists(triples=t, seeds=own)["graph"]) == {"a"}
    made = index.build(v, lists=1)
    assert lists(by=made, tree={"kind": "note"})["cosine_0"] == lists(tree={"kind": "note"})["cosine_0"]


def test_top_k_by_filter_keeps_no_pairs_of_all(spark, sf, monkeypatch):
    from tessera.operators import vector
    from tessera.plans import search_queries

    monkeypatch.setattr(vector, "score_queries", None)  # every task keeps only what may be among the nearest
    assert search_queries.vec_top_k_by_filter(spark, sf).count() > 0


def test_adaptive_k_keeps_no_pairs_of_all(spark, sf, monkeypatch):
    from tessera.operators import vector
    from tessera.plans import rank_queries

    monkeypatch.setattr(vector, "score_queries", None)
    assert rank_queries.rank_adaptive_k(spark, sf).count() > 0


def test_idf_of_arrays_counts_each_entity_once(spark):
    from tessera.operators import keywords

    rows = [("a", ["x", "y", "x"]), ("a", ["x", "z"]), ("b", ["x", None]), ("gone", ["x"]), ("c", []), ("d", None), ("lost", ["y"])]
    words = spark.createDataFrame(rows, "entity_id string, keywords array<string>")
    records = spark.createDataFrame([(i, "deleted" if i == "gone" else "active") for i in ("a", "b", "b", "c", "d", "gone")], "id string, status string")
    got = keywords.keyword_idf(words, records)
    plain = keywords.keyword_idf(words.select("entity_id", F.explode("keywords").alias("keyword")), records)
    assert {(r.keyword, r.freq) for r in got.collect()} == {("x", 2), ("y", 1), ("z", 1), (None, 1)}
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
