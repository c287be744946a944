"""Contexts, diaries, conflicts, profiles, templates and transcripts by hand; hubs and groups in bounded rows."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import dedup, kg, records, state


def test_contexts(spark):
    rows = [
        (1, ["a", " ", "b", None], ["café", "x"], ["E"]), (2, ["a"], ["k", "l"], ["E"]), (3, None, ["k", "l"], ["E"]), (4, ["a", "b"], ["", "k"], ["E"]), (5, ["a", "b"], ["k", "l"], []),
        (6, list("abcdefg"), list("abcdefg"), ["é"] * 12), (7, ["a", "b"], ["k", "l"], None),
    ]
    df = spark.createDataFrame(rows, "id int, queries array<string>, keywords array<string>, entities array<string>")
    got = {r.id: r for r in records.validate_contexts(df).collect()}
    assert {i: r.problem for i, r in got.items()} == {1: None, 2: "queries", 3: "queries", 4: "keywords", 5: "entities", 6: None, 7: "entities"}
    assert (got[1].queries, got[1].keywords, got[1].entities) == (["a", "b"], ["cafe", "x"], ["E"]) and got[2].queries is None
    assert (len(got[6].queries), len(got[6].keywords), got[6].entities) == (5, 5, ["é"] * 10)
    read = {r.id: (r.problem, r.entities) for r in records.validate_contexts(df, reading=True).collect()}
    assert read[5] == (None, []) and read[7] == (None, []) and read[2][0] == "queries"


def test_diaries(spark):
    e = spark.createDataFrame(
        [("The Agent", "one", "", None, datetime(2024, 1, 1, 9, 5, 7)), ("The Agent", "two", "My Slug!", "Plans", datetime(2024, 1, 2)), ("", "x", None, None, None), ("Other", " ", None, None, None)],
        "agent string, entry string, slug string, topic string, at timestamp",
    )
    r = records.diary_records(e)
    assert {x.id: (x.topic, x.date, x.added_by) for x in r.collect()} == {"diary_agent_20240101-090507-general": ("general", "2024-01-01", "The Agent"), "diary_agent_my-slug": ("Plans", "2024-01-02", "The Agent")}
    got = records.read_diary(r, spark.createDataFrame([("The Agent",), ("Nobody",)], "agent string"), 1).collect()
    assert [(x.content, x.position, x.total) for x in got] == [("two", 1, 2)]


def test_hints(spark):
    p = spark.createDataFrame([("c2", ("merge", "2024-01-02T10", " " + "y" * 101)), ("c1", ("keep", None, None)), ("c3", None)], "id string, past_resolution struct<action: string, when: string, reason: string>").withColumn("q", F.lit(1))
    hint = records.resolution_hints(p, ["q"]).first().hint.split("\n")
    assert hint[1:] == ["  • c1: last time you chose 'keep' () — ", "  • c2: last time you chose 'merge' (2024-01-02) — " + "y" * 97 + "..."]
    assert records.resolution_hints(p.where("id = 'c3'"), ["q"]).count() == 0


def test_templates(spark):
    c = spark.createDataFrame(
        [(["b", "a", ""], " T ", "always", "do it", ["", "late"]), (["a", "b"], "A longer title", "when it is late in the day", "do it", None), (["a"], "T", "u", "r", None), (["a", "b"], "", "u", "r", None), (None, "T", "u", "r", None)],
        "op_ids array<string>, title string, when_to_use string, recipe string, failure_modes array<string>",
    )
    made, edges = records.operation_templates(c)
    rows = made.collect()
    assert len(rows) == 1 and rows[0].id.startswith("record_op_template_") and {tuple(e) for e in edges.collect()} == {(rows[0].id, "templatizes", x) for x in "ab"}
    one = records.operation_templates(c.limit(1))[0].first()
    assert one.what == "operation template: T" and one.why == "always (operation template covering 2 clustered operations)" and one.content.endswith("## Failure modes\n- late\n\nDerived from 2 operation(s): b, a")


def test_transcripts(spark):
    t = spark.createDataFrame(
        [("x\n⏺  1:05 AM Friday, May 3, 2024\nMaria here\n> ./run me\n> Fix: the  login-page, now!", 1), ("> tiny\n/Users/jd/x mariana", 2), (None, 3), ("⏺ 1:05 AM Friday, Floréal 3, 2024", 4), ("\n" * 60 + "⏺ 1:05 AM Friday, May 3, 2024\n> a prompt far down", 5)],
        "text string, id int",
    )
    people, users = spark.createDataFrame([("MARIA",), ("Bob",)], "name string"), spark.createDataFrame([("jd", "John")], "username string, name string")
    got = {r.id: (r.stamp, r.date, r.people, r.subject) for r in records.session_metadata(t, people, users).collect()}
    assert got == {
        1: ("2024-05-03_105AM", "2024-05-03", ["MARIA"], "Fix-the-login-page-now"), 2: (None, None, ["John"], "session"), 3: (None, None, [], "session"),
        4: ("2024-00-03_105AM", "2024-00-03", [], "session") if got[4][0] else (None, None, [], "session"), 5: (None, None, [], "a-prompt-far-down"),
    }


def test_a_hub_is_cut_before_it_is_joined(spark):
    """A walk from a hub of many edges: the nodes that a walk over all edges gives, from a bounded number of rows."""
    edges = [("hub", f"n{i:05}") for i in range(3000)] + [(f"n{i:05}", f"m{i % 50:03}") for i in range(0, 3000, 7)] + [("s", "hub"), ("m001", "end")]
    t = spark.createDataFrame([(a, "near", b, None) for a, b in edges], "subject string, predicate string, object string, valid_to string")
    seeds = spark.createDataFrame([("s",), ("hub",), ("end",)], "id string")
    walk = kg.graph_walk(t, seeds, budget=30)
    got = {}
    for r in walk.collect():
        got.setdefault(r.seed, set()).add((r.hop, r.id))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for s in ("s", "hub", "end"):
        seen, front, found = {s}, {s}, []
        for hop in (1, 2, 3):
            front = set(sorted({x for n in front for x in near.get(n, ())} - seen)[:30])
            seen |= front
            found += [(hop, x) for x in sorted(front)]
        assert got[s] == set(found[:30])
    plan = walk._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_latest_state_combines_first(spark):
    r = spark.createDataFrame([(i, f"e{i % 3}", "s", None if i == 299 else f"p{i}", i // 10, "x") for i in range(300)], "rev_id long, entity_id string, schema_id string, payload string, created_at long, session_id string")
    out = state.latest_state(r)
    assert out.columns == r.columns and {x.entity_id: x.rev_id for x in out.collect()} == {"e0": 297, "e1": 298}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_greedy_rules_of_odd_vectors(spark):
    """Nulls, other lengths and no direction; a group is taken as a run, whatever its size."""
    rows = [("d", i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.1], None, [0.0, 0.0], [1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0], [1.0, None], [0.0, 3.0]])]
    v = spark.createDataFrame(rows, "domain string, id long, embedding array<double>").repartition(3)
    got = {r.id: r.leader for r in dedup.leader_clusters(v, 0.9).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 6}
    d = v.select(F.lit("f").alias("source_file"), "id", F.lit("a text that is long enough for all").alias("text"), "embedding")
    assert {r.id: r.kept for r in dedup.dedup_sources(d).collect()} == {0: True, 1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False}
