"""Pages, rooms, contexts behind hits, templates, reports and vector scoring by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedup, rendering, services, state, vector


def test_pages_cover_all_rows(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(25)] + [(None,)], "id string").repartition(4)
    seen, after = [], None
    while rows := rendering.page(df, "id", 10, after).collect():
        seen += [r.id for r in rows]
        after = rows[-1].id
    assert seen == [f"k{i:03}" for i in range(25)]


def test_rooms(spark):
    texts = ["I debug the API server", "plan and scope, then code and test", "x" * 3000 + " code", None, "", "Nothing here"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rendering.room_of("t")).collect()]
    assert got == ["technical", "technical", "general", "general", "general", "general"]


def test_contexts_behind_hits(spark):
    hits = spark.createDataFrame([(1, "m"), (1, "n"), (2, "m")], "query_id int, id string")
    scores = spark.createDataFrame([(1, "m", ["c1", "c2"]), (1, "n", []), (2, "m", ["c9"])], "query_id int, id string, contexts array<string>")
    near = spark.createDataFrame([(1, "c1", 0.12345), (1, "c1", 0.5), (2, "c9", 1.0)], "query_id int, context_id string, weight double")
    known = spark.createDataFrame([("c1", ["q"], ["k"]), ("c2", None, None)], "context_id string, queries array<string>, keywords array<string>")
    marked, told = rendering.similar_contexts(hits, scores, near, known)
    assert {(r.query_id, r.id): r.similar_context_ids for r in marked.collect()} == {(1, "m"): ["c1", "c2"], (1, "n"): None, (2, "m"): ["c9"]}
    assert sorted((r.query_id, r.context_id, r.link_score) for r in told.collect()) == [(1, "c1", 0.5), (1, "c2", None)]


def test_shared_contexts(spark):
    c = spark.createDataFrame([("a", "b"), ("a", "z")], "from_entity string, to_entity string")
    s = spark.createDataFrame([("a", "b", f"c{i}", i) for i in range(7)], "from_entity string, to_entity string, ctx_id string, contributed_ts int")
    x = spark.createDataFrame([("c6", ["p", "q", "r"], None), ("c5", None, ["k"]), ("c0", ["old"], None)], "ctx_id string, queries array<string>, keywords array<string>")
    got = {r.to_entity: r.shared for r in rendering.shared_contexts(c, s, x).collect()}
    assert got == {"b": "- queries=[p, q] keywords=[]\n- queries=[] keywords=[k]", "z": "(no shared context metadata available)"}


def test_missing_vectors(spark):
    e = spark.createDataFrame([(1, "a text"), (2, " "), (3, None), (4, "has one")], "id int, text string")
    made = rendering.missing_vectors(e, e.where("id = 4"), vector.hashing_embedder(8)).collect()
    assert [r.id for r in made] == [1] and len(made[0].embedding) == 8


def test_reports_and_queues(spark):
    d = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, True)], "source_file string, id int, kept boolean")
    assert sorted(map(tuple, dedup.dedup_report(d).collect()), key=str) == [("a", 2, 1, 1), ("b", 1, 1, 0), (None, 3, 2, 1)]
    runs = spark.createDataFrame([("x", "2024-01-01 10:30:00"), ("y", "2024-01-01 10:00:00")], "agent string, t string").select("agent", F.col("t").cast("timestamp").alias("started_ts"))
    waits = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "agent string")
    assert sorted(r.agent for r in state.due(runs, waits, "2024-01-01 11:00:00").collect()) == ["y", "z"]
    assert [r.agent for r in state.due(runs, waits, "2024-01-01 11:00:00", least=2).collect()] == ["z"]
    b = spark.createDataFrame([("e", "task_state"), ("e", "intent_state"), ("f", "task_state"), (None, "task_state")], "entity_id string, schema_id string")
    first = state.initial_revisions(b, b.where("entity_id = 'f'"), "now")
    assert [(r.rev_id, r.payload) for r in first.collect()] == [("init_e", '{"todos":[]}')]
    assert state.initial_revisions(b, first, "now").where("entity_id = 'e'").count() == 0


def test_coerced_summary(spark):
    df = spark.createDataFrame([(" Café plan ", "because of the größte need", " "), ("x", "because of the need", None)], "w string, y string, s string")
    a, b = df.select(T.coerced_summary("w", "y", "s").alias("m")).select("m.*").collect()
    assert tuple(a) == ("Cafe plan", "because of the grosste need", None, None) and b.problem == "what is too short" and b.what is None


def test_a_gate_tells_of_its_failures(spark):
    r = spark.createDataFrame([("q", "a", "t", 1), ("p", "b", "u", 2)], "query_id string, id string, text string, rank int")

    def judge(rows):
        if rows["query_id"].iloc[0] == "q":
            raise ValueError("no answer")
        return rows["rank"] < 2

    got = {x.id: (x.keep, x.failure) for x in services.gate(r, judge).collect()}
    assert got == {"a": (True, "ValueError: no answer"), "b": (False, None)}


# ---- vectors in blocks ----


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))


@pytest.mark.parametrize("block,queries", [(8192, 512), (7, 3)])
def test_scores_against_loops(spark, monkeypatch, block, queries):
    """Nulls, other lengths, ties and exclusions, in blocks of any size."""
    monkeypatch.setattr(vector, "BLOCK", block)
    monkeypatch.setattr(vector, "QUERIES", queries)
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, 2.0]), (63, [1.0, None, 0.0, 0.0])]
    asks = [(f"q{i}", i % 2, v) for i, (_, v) in enumerate(rows[:8])] + [("q8", 0, [3.0, 4.0]), ("q9", 0, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asks, "query_id string, view int, query array<double>")
    want = {(a, w, i): cosine(x, e) for a, w, x in asks for i, e in rows}
    got = {(s.query_id, s.view, s.id): s.similarity for s in vector.score_queries(q, v).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    out = {("q0", 0), ("q0", 5), ("q1", 7), ("q1", 7)}
    exclude = spark.createDataFrame([*out, ("q1", 7)], "query_id string, id long")
    for gone, e in ((set(), None), (out, exclude)):
        top = {}
        for s in vector.cosine_top_k(q, v, 5, e).collect():
            top.setdefault((s.query_id, s.view), []).append((s.rank, s.id, s.similarity))
        for a, w, _ in asks:
            first = sorted((-round(want[a, w, i], 6), i) for i, _ in rows if (a, i) not in gone)[:5]
            assert [(i, s) for _, i, s in sorted(top[a, w])] == [(i, -s + 0.0) for s, i in first]


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_QUERIES", 2)
    q = spark.createDataFrame([(i, 0, [1.0]) for i in range(3)], "query_id int, view int, query array<double>")
    with pytest.raises(ValueError):
        vector.score_queries(q, spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>"))
    assert vector.cosine_top_k(q.where("false"), spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>"), 3).count() == 0
