"""Operators against numbers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import dedup, entities, feedback, keywords, kg, metrics, ranking, rankers, state, vector
from tessera.plans import rank_queries


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame(
        [("max", "Max", "entity"), ("chess", "chess", "entity"), ("acme", "Acme", "entity"), ("bolt", "Bolt", "entity"), ("person", "person", "class"), ("thing", "thing", "class")],
        "id string, name string, kind string",
    ).withColumn("status", F.lit("active"))
    t = spark.createDataFrame(
        [
            ("t1", "max", "is_a", "person", None, None, None), ("t2", "max", "works_at", "acme", "2020-01-01", "2024-12-31", "Max worked at Acme"),
            ("t3", "max", "works_at", "bolt", "2025-01-01", None, "Max works at Bolt"), ("t4", "max", "does", "chess", "2025-06-01", None, None),
            ("t5", "person", "is_a", "thing", None, None, None), ("t6", "chess", "near", "chess", None, None, None),
        ],
        "id string, subject string, predicate string, object string, valid_from string, valid_to string, statement string",
    ).withColumn("confidence", F.lit(1.0)).withColumn("creation_context_id", F.lit("ctx"))
    return t, e


def ids(df, col="triple_id"):
    return sorted(r[col] for r in df.collect())


def test_as_of_is_closed_at_both_ends(spark, graph):
    t, e = graph
    at = lambda d: ids(kg.query_entity(spark.createDataFrame([("max", d)], "entity string, as_of string"), t, e, "outgoing"))
    assert at("2024-12-31") == ["t1", "t2"] and at("2025-01-01") == ["t1", "t3"]
    assert at("2019-12-31") == ["t1"] and at("2025-06-01") == ["t1", "t3", "t4"]
    assert at(None) == ["t1", "t2", "t3", "t4"]


def test_both_directions_give_a_self_loop_twice(spark, graph):
    t, e = graph
    p = spark.createDataFrame([("chess", "2025-07-01")], "entity string, as_of string")
    assert ids(kg.query_entity(p, t, e)) == ["t4", "t6", "t6"]


def test_stats_degrees_timeline(graph):
    t, e = graph
    s = kg.stats(t, e).first()
    assert (s.entities, s.triples, s.current_facts, s.expired_facts, s.predicates) == (6, 6, 5, 1, "does,is_a,near,works_at")
    assert {r.id: r.degree for r in kg.degrees(t).collect()}["chess"] == 3
    assert {r.id: r.edges for r in kg.edge_counts(t).collect()}["chess"] == 2
    assert [r.triple_id for r in kg.timeline(t, e, "max").collect()] == ["t2", "t3", "t4", "t1"]


def test_closure_and_profile(spark, graph):
    t, _ = graph
    seeds = spark.createDataFrame([("max",)], "id string")
    up = {r.ancestor: r.depth for r in kg.closure(t, seeds).collect()}
    assert up == {"max": 0, "person": 1, "thing": 2}
    cyc = spark.createDataFrame([("a", "is_a", "b", None), ("b", "is_a", "a", None)], "subject string, predicate string, object string, valid_to string")
    assert {r.ancestor: r.depth for r in kg.closure(cyc, spark.createDataFrame([("a",)], "id string")).collect()} == {"a": 0, "b": 1}
    p = spark.createDataFrame([("thing", "far", ["x"]), ("person", "near", ["y"]), ("max", None, None)], "id string, slots string, tools array<string>")
    r = kg.resolve_profile(t, p, seeds).first()
    assert r.slots == "near" and r.tools == ["x", "y"]


def test_no_row_of_a_small_side_is_cut(spark, graph, monkeypatch):
    t, _ = graph
    many = spark.range(100_000, numPartitions=1)
    rules = many.select(F.concat(F.lit("p"), "id").alias("predicate"), F.lit("many-to-one").alias("cardinality"))
    rules = rules.unionByName(spark.createDataFrame([("is_a", "many-to-one"), ("works_at", "many-to-one")], rules.schema)).coalesce(1)
    assert ids(kg.cardinality_violations(t.withColumn("valid_to", F.lit(None).cast("string")), rules)) == ["t2", "t3"]
    scopes = many.select(F.concat(F.lit("s"), "id").alias("schema_id"), F.lit("global").alias("scope"))
    scopes = scopes.unionByName(spark.createDataFrame([("mine", "session")], "schema_id string, scope string").select("schema_id", "scope")).coalesce(1)
    r = spark.createDataFrame([(1, "e", "mine", "a", "s1", 1), (2, "e", "mine", "b", "s2", 2)], "rev_id long, entity_id string, schema_id string, payload string, session_id string, created_at long")
    assert [x.payload for x in state.latest_state(r, scopes, "s1").collect()] == ["a"]
    rooms = many.limit(10_000).select(F.concat(F.lit("r"), "id").alias("room"), F.lit("nothing").alias("summary"))
    rooms = rooms.unionByName(spark.createDataFrame([("last", "a chess club")], rooms.schema)).coalesce(1)
    q = spark.createDataFrame([(1, ["chess"])], "query_id long, keywords array<string>")
    assert rankers.top_rooms(rooms, q, 1).first().room == "last"
    contexts = many.limit(10_001).select(F.concat(F.lit("ctx"), "id").alias("context_id"))
    monkeypatch.setattr(rank_queries, "view", lambda *_: contexts)
    assert rank_queries._near(spark, "").where("query_id = 'ctx1'").count() == 1 + 10_001 - 10


def test_walk_damping(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("a", "x", 1e-5)], "a string, b string, confidence double")
    got = {r.id: (r.hop, round(r.weight, 9)) for r in kg.similar_contexts(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"b": (1, 0.9), "c": (2, round(0.9 * 0.8 * 0.85, 9)), "d": (3, round(0.9 * 0.8 * 0.85 * 0.7 * 0.85**2, 9))}


def test_decay_and_hybrid(spark):
    r = one(spark, S.power_law_decay(F.lit(90.0), F.lit(4)).alias("d"), S.hybrid_score(F.lit(1.2), F.lit(5), F.lit(0.0), F.lit(2.0)).alias("h"), S.wake_up_score(F.lit(4), F.lit(-0.2)).alias("w"))
    assert abs(r.d + 0.2 * (1 - 1 / math.sqrt(2))) < 1e-12 and abs(r.h - 1.0) < 1e-12 and abs(r.w - 39.5) < 1e-12
    r = one(spark, S.age_days(F.lit("2024-01-01T00:00:00Z"), None, "2024-01-03").alias("a"), S.age_days(F.lit("soon"), None, "2024-01-03").alias("b"), S.age_days(F.lit("2025-01-01"), None, "2024-01-03").alias("c"))
    assert (r.a, r.b, r.c) == (2.0, 365.0, 0.0)


def test_cosine_idf_damping(spark):
    r = one(spark, S.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))).alias("c"), S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"), S.idf(F.lit(10), F.lit(1)).alias("i"), S.idf(F.lit(10), F.lit(10)).alias("j"))
    assert abs(r.c - 0.96) < 1e-12 and r.d == 0 and abs(r.i - math.log(9.5 / 1.5 + 1)) < 1e-12 and abs(r.j - math.log(0.5 / 10.5 + 1)) < 1e-12


def test_rrf_and_adaptive_k(spark):
    c = spark.createDataFrame([(1, "cosine_0", 1.0, "a", 0.9), (1, "cosine_0", 1.0, "a", 0.1), (1, "cosine_0", 1.0, "b", 0.5), (1, "graph", 0.7, "b", 3.0)], "query_id int, list_name string, weight double, id string, score double")
    got = {r.id: (round(r.rrf, 12), r.channels, r.primary) for r in ranking.rrf(c).collect()}
    assert got == {"a": (round(1 / 61, 12), "cosine", "cosine_0"), "b": (round(1 / 62 + 0.7 / 61, 12), "cosine,graph", "cosine_0")}

    def cut(scores):
        df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "q int, id int, s double")
        return ranking.adaptive_k(df, ["q"], "s", "id").count()

    assert [cut(s) for s in ([9, 8.9, 8.8, 1, 0.9], [5, 5, 5], [7], [3, 2, 1], list(range(40, 0, -1)))] == [3, 3, 1, 3, 20]


def test_feedback(spark):
    r = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (9,), (None,)], "relevance int").select(feedback.is_useful("relevance").alias("u"), feedback.confidence("relevance").alias("c")).collect()
    assert [(x.u, x.c) for x in r] == [(False, 1.0), (False, 0.5), (True, 0.2), (True, 0.8), (True, 1.0), (True, 0.2), (True, 0.2)]
    n = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5)], "query_id string, context_id string, weight double")
    e = spark.createDataFrame([("a", "m", "rated_useful", 0.8), ("b", "m", "rated_irrelevant", 1.0), ("b", "n", "surfaced", 1.0)], "context_id string, memory_id string, kind string, confidence double")
    got = {x.id: (x.rated, round(x.recall, 9), x.contexts) for x in feedback.neighbourhood_scores(n, e).collect()}
    assert got["n"] == (None, 0.15, ["b"]) and abs(got["m"][0] - 0.3) < 1e-9 and got["m"][2] == ["b"]


def test_learned_weights_need_ten_rows(spark):
    base = spark.createDataFrame([("sim", 0.6), ("rel", 0.4)], "component string, base double")
    obs = lambda n: spark.createDataFrame([("rel", 1.0, True), ("rel", 0.0, False)] * n, "component string, component_value double, was_useful boolean")
    assert {r.component: r.weight for r in feedback.learned_weights(obs(4), base).collect()} == {"sim": 0.6, "rel": 0.4}
    got = {r.component: r.weight for r in feedback.learned_weights(obs(5), base).collect()}
    assert abs(got["rel"] - 0.52 / 1.12) < 1e-12


def test_adamic_adar_once_per_context(spark):
    m = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "d"), ("c3", "a"), ("c3", "b")], "context_id string, entity string")
    r = spark.createDataFrame([("c1", 5), ("c1", 3), ("c2", 4), ("c3", 3)], "context_id string, relevance int")
    got = {(x.a, x.b): round(x.score, 9) for x in feedback.adamic_adar(m, r).collect()}
    assert got == {("a", "b"): round(1 / math.log(2) + 1 / math.log(3), 9), ("a", "d"): round(1 / math.log(3), 9), ("b", "d"): round(1 / math.log(3), 9)}


def test_keyword_channel_cold_start(spark):
    p = spark.createDataFrame([("e1", "x"), ("e1", "Y"), ("e2", "x")], "entity_id string, keyword string")
    q = spark.createDataFrame([(1, "X"), (1, "y"), (2, "x")], "query_id int, keyword string")
    none = spark.createDataFrame([], "keyword string, idf double")
    assert {(r.query_id, r.id): r.score for r in keywords.keyword_channel(q, p, none).collect()} == {(1, "e1"): 2.0, (1, "e2"): 1.0, (2, "e1"): 1.0, (2, "e2"): 1.0}


def test_metrics(spark):
    p = spark.createDataFrame([("c", 1, 0.9, 0), ("c", 2, 0.8, 1), ("c", 3, 0.8, 0), ("c", 4, 0.1, 1)], "context_id string, id int, score double, label int")
    r = metrics.ranking_metrics(p, ["context_id"], k=3).first()
    assert abs(r.ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9 and abs(r.precision - 1 / 3) < 1e-9 and r.recall == 0.5
    assert metrics.auc(p, ["context_id"]).first().auc == 0.125
    c = {round(x.threshold, 2): (x.accepted, x.recall) for x in metrics.savings_curve(p).collect()}
    assert c[0.0] == (4, 1.0) and c[0.8] == (3, 0.5) and c[0.85] == (1, 0.0) and c[1.0] == (0, 0.0)


def test_multi_view(spark):
    v = spark.createDataFrame([("o1", 1, [1.0, 0.0]), ("o1", 2, [0.0, 1.0]), ("o2", 3, [1.0, 1.0])], "owner_id string, id int, embedding array<float>")
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0])], "query_id int, view int, query array<float>")
    got = {r.owner_id: (round(r.max_sim, 6), round(r.min_sim, 6)) for r in vector.min_max_similarity(q, v).collect()}
    h = round(math.sqrt(0.5), 6)
    assert got == {"o1": (1.0, h), "o2": (1.0, h)}
    assert vector.resolve_contexts(q, v).first().reused is False


def test_pairs_of_queries_and_owners_do_not_travel(spark, monkeypatch):
    monkeypatch.setattr(vector, "OWNERS", 7)
    monkeypatch.setattr(vector, "QUERIES", 3)
    rng = np.random.default_rng(5)
    vecs = [(i, i % 9 if i % 10 else None, None if i == 4 else [0.0, 0.0] if i == 5 else rng.normal(size=3 if i % 13 == 0 else 2).tolist()) for i in range(120)]
    asked = [(k, v, rng.normal(size=2).tolist()) for k in range(5) for v in range(k + 1)] + [(0, 0, [1.0, 0.5]), (3, 1, None)]
    v = spark.createDataFrame(vecs, "id int, owner_id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, view int, query array<double>")

    def cosine(a, b):
        return 0.0 if a is None or b is None or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    want = {}
    for k in {a[0] for a in asked}:
        for o in {x[1] for x in vecs}:
            best = {}
            for _, w, e in (a for a in asked if a[0] == k):
                best[w] = max([best.get(w, 0.0), *(cosine(e, x[2]) for x in vecs if x[1] == o)])
            want[k, o] = (round(max(best.values()), 9), round(min(best.values()), 9))
    found = vector.min_max_similarity(q, v)
    assert {(r.query_id, r.owner_id): (round(r.max_sim, 9), round(r.min_sim, 9)) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "Join" not in plan
    near = spark.createDataFrame([(0, 1), (3, 2), (4, 8)], "query_id int, owner_id int")
    got = {(r.query_id, r.owner_id): (round(r.max_sim, 9), round(r.min_sim, 9)) for r in vector.near_extremes(q, v, near).collect()}
    assert got == {k: want[k] for k in [(0, 1), (3, 2), (4, 8)]}


def test_text_functions(spark):
    def f(c):
        return one(spark, c.alias("x")).x

    assert f(T.normalize_entity_name(F.lit("  The HTTPServerÉlan--v2 "))) == "http_server_elan_v2"
    assert f(T.normalize_entity_name(F.lit("!!"))) == "unknown"
    assert f(T.normalize_predicate(F.lit(" Works - At "))) == "works_at"
    assert f(T.detect_content_type(F.lit("a bug in the api code"))) == "fact"
    assert f(T.sentiment(F.lit("a broken bug, but fixed"))) == "negative"
    assert f(T.extract_prose(F.lit("hello\n```\nx = 1\n```\n$ ls\nbye"))) == "hello\nbye"
    assert f(T.prompt_keywords(F.lit("What about the red-car and the RED-car or x?"))) == ["red-car"]
    assert f(T.token_f1(F.lit("the cat sat"), F.lit("A cat sat down"))) == pytest.approx(0.8)
    assert f(T.quoted_phrases(F.lit("say 'red car' or \"blue bus\""))) == ["red car", "blue bus"]
    assert f(T.person_names(F.lit("What did Anna tell Bob? Anna!"))) == ["Anna", "Bob"]
    assert f(T.bounded_correction(F.lit("teh"), F.lit("the"))) == "the" and f(T.bounded_correction(F.lit("abc"), F.lit("xyzw"))) == "abc"
    assert f(T.relative_days(F.lit("3 weeks ago")))[0] == 21
    assert f(T.temporal_boost(F.lit(10), F.lit(7), F.lit(2))) == pytest.approx(0.3)
    assert f(T.preferences(F.lit("I prefer dark mode. I used to play chess!"))) == ["dark mode", "play chess"]
    assert f(T.summary_problem(F.lit("abc"), F.lit("x" * 20), F.lit(None).cast("string"))) == "what is too short"
    assert f(T.extract_content(F.lit('[{"type":"text","text":"a"},"b"]'))) == "a b"
    long = "x" * 150 + ". " + "y" * 100 + "\nWhere is it now, please?"
    assert f(T.sanitize_query(F.lit(long)))[:2] == ("Where is it now, please?", "question_extraction")


def test_entities(spark):
    text = "Anna said hi. Anna asked. hey Anna\nAnna: she laughed\npip install Bolt\nimport Bolt\nBolt.py Bolt"
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r.name: (r.frequency, r.type) for r in entities.classify(entities.scores(entities.candidates(d).join(d, "doc_id"))).collect()}
    assert got["Anna"] == (4, "person") and got["Bolt"] == (4, "project")


def test_dedup_is_greedy_longest_first(spark):
    rows = [("s", i, "t" * (30 + n), v) for i, n, v in ((1, 0, [1.0, 0.0]), (2, 5, [1.0, 0.05]), (3, 1, [0.0, 1.0]), (4, 2, [1.0, 1.0]))] + [("s", 5, "short", [5.0, -1.0])]
    df = spark.createDataFrame(rows, "source_file string, id int, text string, embedding array<float>")
    assert {r.id: r.kept for r in dedup.dedup_sources(df).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_state(spark):
    cols = "rev_id string, entity_id string, schema_id string, payload string, created_at string, schema_version int, session_id string"
    r = spark.createDataFrame(
        [("r1", "p", "project_state", '{"current_phase":"a","blockers":["x"],"open_questions":["q"],"recent_milestones":["1","2","3","4","5","6"]}', "2024-01-01", 1, None), ("r2", "g", "agent_state", "{}", "2024-01-01", 2, None), ("r3", "d", "task_state", None, "2024-01-02", 1, None)], cols
    )
    out = state.migrate_latest(r, "2024-02-01").collect()
    assert [x.rev_id for x in out] == ["r1_v2"]
    assert '"open_todos":[{"id":"b1","text":"x","status":"blocked","blocker":"x"},{"id":"q1","text":"q","status":"pending"}]' in out[0].payload and '"name":"1"' not in out[0].payload
    e = "id string, name string, kind string, content string, importance int, properties string, session_id string, intent_id string, status string, ts string"
    cur = spark.createDataFrame([("a", "A", "entity", "old", 5, "{}", "s1", None, "deleted", "1")], e)
    new = spark.createDataFrame([("a", "B", "class", "", 3, '{"x":1}', "s2", "i", "x", "2")], e)
    u = state.upsert_entities(cur, new).first()
    assert (u.name, u.kind, u.content, u.importance, u.session_id, u.intent_id, u.status) == ("B", "class", "old", 5, "s1", "i", "active")
    assert one(spark, state.merge_properties(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')).alias("x")).x == '{"a":"1","b":"3"}'


def test_rankers(spark):
    r = one(spark, F.round(rankers.hybrid_v4("d", F.lit(0.5), F.lit(0.4), F.lit(1.0), F.lit(0.5)), 6).alias("x")) if False else spark.range(1).select(F.lit(1.0).alias("d")).select(F.round(rankers.hybrid_v4("d", F.lit(0.5), F.lit(0.4), F.lit(1.0), F.lit(0.5)), 6).alias("x")).first()
    assert r.x == round(0.85 * 0.6 * 0.4 * 0.8, 6)
    s = rankers.split_dev(spark.range(200).select("id"), 50)
    assert s.where("part = 'dev'").count() == 50


def test_fusion_shuffles_candidates_once(spark):
    c = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.lit("a_0").alias("list_name"), F.lit(1.0).alias("weight"), "id", F.col("id").cast("double").alias("score"))
    plan = ranking.rrf(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_queries_with_the_same_neighbours_share_their_sums(spark):
    from tessera.operators import feedback

    n = spark.createDataFrame([("q", "a", 1.0), ("r", "a", 1.0), ("a", "a", 1.0), ("s", "a", 1.0), ("s", "b", 0.5), (None, "a", 1.0), ("t", "a", 1.0), ("t", "a", 1.0), ("u", None, 1.0)], "query_id string, context_id string, weight double")
    r = spark.createDataFrame([("a", "m", "rated_useful", 0.5), ("b", "m", "rated_irrelevant", 0.4), ("b", "k", "surfaced", 1.0), (None, "m", "rated_useful", 1.0)], "context_id string, memory_id string, kind string, confidence double")
    found = feedback.neighbourhood_scores(n, r)
    got = {(x.query_id, x.id): (x.rated and round(x.rated, 9), round(x.recall, 9), x.contexts) for x in found.collect()}
    assert got == {
        ("q", "m"): (0.5, 0.5, ["a"]), ("r", "m"): (0.5, 0.5, ["a"]), ("a", "m"): (0.5, 0.5, []), ("s", "m"): (0.3, 0.3, ["a", "b"]),
        ("s", "k"): (None, 0.15, ["b"]), (None, "m"): (0.5, 0.5, []), ("t", "m"): (1.0, 1.0, ["a"]),
    }
    assert "Aggregate [query_id" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines(True) if "memory_id" in x)
