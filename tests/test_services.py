import json

from pyspark.sql import functions as F

from tessera.api import KnowledgeGraph
from tessera.functions import halls
from tessera.operators import services as S
from tessera.sources import benchmarks as B


def test_views(spark):
    e = spark.createDataFrame([("a", ["q1", "q2"], "sum"), ("b", ["q"], "")], "id string, queries array<string>, summary string")
    got = sorted((r.view_id, r.text, r.is_summary_view) for r in S.explode_views(e).collect())
    assert got == [("a__v0", "q1", False), ("a__v1", "q2", False), ("a__v2", "sum", True), ("b__v0", "q", False)]
    t = spark.createDataFrame([("x", "what", "why so", None, ["p"])], "id string, what string, why string, scope string, probes array<string>")
    assert sorted((r.view_kind, r.view_id, r.text) for r in S.three_levels(t).collect()) == [("abstract", "x", "what -- why so"), ("identity", "x__identity", "what"), ("probe", "x__v0", "p")]
    assert [r.id for r in S.missing_summary_views(e, S.explode_views(e).where("owner_id <> 'a'")).collect()] == ["a"]


def test_gate_fails_open(spark):
    r = spark.createDataFrame([("q", "a", "t", 1), ("q", "b", "u", 2)], "query_id string, id string, text string, rank int")
    keep = lambda f: sorted((x.id, x.keep) for x in S.gate(r, f).collect())
    assert keep(None) == [("a", True), ("b", True)] == keep(lambda p: 1 / 0)
    assert keep(lambda p: p["rank"] < 2) == [("a", True), ("b", False)]
    replies = spark.createDataFrame([("q", '{"decisions":[{"id":"a","action":"drop"},{"id":"a","action":"keep"},{"id":"z","action":"keep"}]}'), ("q", "broken")], "query_id string, reply string")
    assert [(x.id, x.keep) for x in S.parse_decisions(replies, r).collect()] == [("a", False)]
    assert S.drops_as_feedback(S.gate(r, lambda p: p["rank"] < 2), "t").first().memory_id == "b"


def test_patch():
    doc = '{"a":[1,2],"b":{"c":3}}'
    ok = [{"op": "add", "path": "/a/-", "value": 9}, {"op": "replace", "path": "/b/c", "value": 4}, {"op": "copy", "from": "/b", "path": "/d"}, {"op": "move", "from": "/a/0", "path": "/e"}, {"op": "test", "path": "/e", "value": 1}, {"op": "remove", "path": "/b"}]
    assert json.loads(S.apply_patch(doc, json.dumps(ok))) == {"a": [2, 9], "d": {"c": 4}, "e": 1}
    for bad in ([{"op": "replace", "path": "/zz", "value": 1}], [{"op": "test", "path": "/b/c", "value": 5}], [{"op": "remove", "path": "/a/7"}], "x"):
        assert S.apply_patch(doc, json.dumps(bad)) is None


def test_layers_and_pairs(spark):
    r = spark.createDataFrame([("me", i, "t" * 300, 5 if i < 3 else 1, 1.0) for i in range(8)] + [("me", 0, "t" * 300, 5, 1.0)], "agent string, id int, text string, importance int, age double")
    out = S.layer_one(r).collect()
    assert sorted(x.id for x in out) == [0, 1, 2] and out[0].snippet == "t" * 200
    p = spark.createDataFrame([(1, 1, "a b", "a b c"), (1, 2, "a b", "b"), (1, 3, "a b", "x")], "query_id int, id int, query string, text string")
    assert [x.id for x in S.pair_scores(p, threshold=0.4).orderBy("rank").collect()] == [1, 2]


def test_facts_and_metadata(spark):
    f = spark.createDataFrame([("Max", "person", None, ["Ann"], ["chess", "go"])], "name string, type string, partner string, parents array<string>, interests array<string>")
    assert sorted((r.predicate, r.object) for r in S.facts_to_triples(f).collect()) == [("child_of", "Ann"), ("is_a", "person"), ("loves", "chess"), ("loves", "go")]
    m = spark.createDataFrame([("1", "k", "v"), ("1", "w", "x")], "id string, key string, value string")
    assert S.pivot_metadata(m, ["k", "w"]).first().asDict() == {"id": "1", "k": "v", "w": "x"}


def test_halls(spark):
    row = lambda u, a: spark.range(1).select(halls.session_hall(F.lit(u), F.lit(a)).alias("h")).first().h
    assert [row("I prefer tea", ""), row("hi", "I suggest x. Here are two"), row("my birthday", ""), row("my job in the city", ""), row("hi", "ho")] == ["hall_preferences", "hall_assistant", "hall_events", "hall_facts", "hall_general"]
    q = lambda t: spark.range(1).select(halls.question_halls(F.lit(t)).alias("h")).first().h
    assert q("What did you say you suggested?")[0] == "hall_assistant" and q("Which city?")[0] == "hall_facts"


def test_benchmark_shapes(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question_id": "1", "question_type": "t", "question": "q", "answer_session_ids": ["s2"], "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["d1", "d2"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}, {"role": "assistant", "content": "c"}]]}]))
    s = B.longmem_sessions(B.longmem_questions(spark, str(tmp_path / "q.json"))).orderBy("pos").collect()
    assert [(r.session_id, r.date, r.text, r.is_answer) for r in s] == [("s1", "d1", "a", False), ("s2", "d2", "b", True)]
    c = spark.createDataFrame([("c", json.dumps({"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}], "session_1_date_time": "now"}))], "conv_id string, conversation string")
    assert [(r.id, r.text) for r in B.locomo_documents(B.locomo_sessions(c)).collect()] == [("D1", "A: hi")]
    m = spark.createDataFrame([(1, [[("s", None, "u", None, "a", None, "t")]])], f"tid int, message_list array<array<{B.MEMBENCH_TURN}>>")
    assert [(r.sid, r.global_id, r.text) for r in B.membench_turns(m).collect()] == [("s", 0, "[t] [User] u [Assistant] a")]


def test_graph_object(spark):
    e = spark.createDataFrame([("a", "A", "entity", "active"), ("b", "B", "entity", "active"), ("c", "C", "entity", "active")], "id string, name string, kind string, status string")
    t = spark.createDataFrame([("1", "a", "knows", "b", None, None, 1.0), ("2", "c", "knows", "b", None, None, 1.0)], "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    g = KnowledgeGraph(e, t)
    assert g.query_entity("b").count() == 2 and g.query_entity("b", direction="outgoing").count() == 0
    m = g.merge(spark.createDataFrame([("c", "a")], "source string, target string"))
    assert m.triples.count() == 1 and m.aliases.first().asDict() == {"alias": "c", "canonical_id": "a"}
    assert g.delete(spark.createDataFrame([("a",)], "id string"), "2024").triples.where("valid_to IS NULL").count() == 1
    g.register()
    assert spark.sql("SELECT count(*) AS n FROM triples").first().n == 2


def test_pair_scores_ask_for_every_benchmark_text(spark, tmp_path):
    from tessera.plans.service_queries import rank_pair_scores

    texts = [(i, f"alpha{i} beta{i} gamma{i} delta") for i in (0, 1, 7, 49, 50, 101)]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(10 + i, t) for i, t in texts] + [(5, "nothing of it"), (6, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = {r.query_id: r.id for r in rank_pair_scores(spark, str(tmp_path)).where("rank = 1").collect()}
    assert first == {i: 10 + i for i, _ in texts}
