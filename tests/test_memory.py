"""Segments, enrichment and merges against plain evaluations."""

import random
import re

import pytest

from tessera.functions import text as T
from tessera.functions.segments import segments
from tessera.operators import enrich, merges

# ---- segments ----


def plain_segments(text):
    """The rule on one text, line by line."""
    lines = (text or "").split("\n")
    opens = [bool(re.match(r">\s|(human|user|q|assistant|ai|a|claude|chatgpt)\s*:", x.strip(), re.I)) for x in lines]
    if sum(opens) >= 3:
        out = []
        for x, o in zip(lines, opens):
            if o or not out:
                out.append([x])
            else:
                out[-1].append(x)
        return [s for s in ("\n".join(x) for x in out) if s.strip()]
    own = [p.strip() for p in (text or "").split("\n\n") if p.strip()]
    if len(own) <= 1 and len(lines) > 20:
        own = [g for g in ("\n".join(lines[i : i + 25]).strip() for i in range(0, len(lines), 25)) if g]
    return own


def test_segments(spark):
    r = random.Random(1)
    pieces = ["> what now", ">no blank", "> ", "Human: hi", "  user : hello", "AI: yes", "a: b", "claude said: x", "plain line", "", "", "\tindented", "Q:", "x\r", "ChatGPT :ok", "über uns", "> \t y"]
    texts = ["\n".join(r.choice(pieces) for _ in range(r.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", "\n\n\n", "one", "\n".join(["line"] * 21), "\n".join(["line"] * 20), "\n".join(["line"] * 76), "a\n\n\nb\n\n c ", "> a\n> b\n> c\n", "\n> a\n> b\n> c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {}
    for x in segments(df).orderBy("id", "segment_index").collect():
        assert x.segment_index == len(got.setdefault(x.id, []))
        got[x.id].append(x.content)
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_segments(t), t


def test_memories_are_numbered_within_a_text(spark):
    t = "We decided to go with Postgres because it is simpler.\n\ntoo short\n\nNothing to see in this paragraph at all.\n\nI prefer tabs, I always use them and I like dark mode."
    got = T.extract_memories(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string"), "id").orderBy("chunk_index").collect()
    assert [(r.id, r.chunk_index, r.memory_type) for r in got] == [(1, 0, "decision"), (1, 1, "preference")]


def test_scores_are_computed_once(spark, sf):
    """No filter or projection of the plan repeats the patterns of another."""
    from tessera.plans import text_queries

    plan = text_queries.ingest_extract_memories(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and plan.count("aggregate(split(") <= 3


# ---- enrichment ----


def plain_enrich(state, emits, most=20, near=0.85):
    q, v, k, e = ([*(x or [])] for x in state)
    log = []
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for nq, nv, nk, ne in emits:
        exact = [(t.strip(), x) for t, x in zip(nq, nv) if t and t.strip() and t.strip() not in q]
        fresh = [(t, x) for t, x in exact if not any(cos(x, o) >= near for o in v)]
        q, v = q + [t for t, _ in fresh], v + [x for _, x in fresh]
        out = max(0, len(q) - most)
        q, v = q[out:], v[out:]
        n_k, n_e = 0, 0
        for x in nk:
            if x.strip() and x.strip().lower() not in {y.strip().lower() for y in k}:
                k, n_k = [*k, x.strip()], n_k + 1
        for x in ne:
            if x and x not in e:
                e, n_e = [*e, x], n_e + 1
        log.append((len(fresh), len(exact) - len(fresh), n_k, n_e, out))
    return (q, v, k, e), log


SCHEMA = "context_id string, {}queries array<string>, vectors array<array<double>>, keywords array<string>, entities array<string>"


def test_enrichment(spark):
    r = random.Random(7)
    vec = lambda: [float(r.randint(-3, 3)) or 1.0 for _ in range(3)]  # noqa: E731  few directions, so that many are near and many tie
    emit = lambda: (lambda n: ([r.choice(["", " ", "x", f"q{r.randint(0, 60)} "]) for _ in range(n)], [vec() for _ in range(n)], [r.choice(["Tag", "tag", "b ", ""]) for _ in range(n)], [r.choice(["thing_1", "thing_2"]) for _ in range(n)]))(r.randint(0, 5))
    states = {f"c{i}": emit() for i in range(6)} | {"full": ([f"old {i}" for i in range(20)], [[1.0, float(i * i), float(-i)] for i in range(20)], [], [])}
    emits = {c: [emit() for _ in range(25)] for c in states}
    emits["c5"] = []
    s = spark.createDataFrame([(c, *x) for c, x in states.items()], SCHEMA.format(""))
    e = spark.createDataFrame([(c, i, *x) for c, xs in [*emits.items(), ("nowhere", [emit()])] for i, x in enumerate(xs)], SCHEMA.format("seq long, ")).repartition(5)
    # the state's own blank texts and repeats stay as they are
    want = {c: plain_enrich((x[0], x[1], x[2], list(x[3])), emits[c]) for c, x in states.items()}
    got = {x.context_id: x for x in enrich.enrich(s, e).collect()}
    assert set(got) == set(states)
    for c, ((q, v, k, ent), _) in want.items():
        assert (got[c].queries, got[c].vectors, got[c].entities) == (q, v, ent) and len(q) <= 20
        assert [x.strip() for x in got[c].keywords] == [x.strip() for x in k]
    log = {}
    for x in enrich.enrichment_log(s, e).orderBy("seq").collect():
        log.setdefault(x.context_id, []).append(tuple(x)[2:])
    assert log == {c: w[1] for c, w in want.items() if w[1]}
    assert any(x[4] for w in log.values() for x in w) and any(x[1] for w in log.values() for x in w)


def test_enrichment_of_nulls_and_nothing(spark):
    s = spark.createDataFrame([("a", None, None, None, None)], SCHEMA.format(""))
    e = spark.createDataFrame([("a", 1, None, None, None, None), ("a", 2, ["q", None], None, ["k", None], ["Café Bar", " ", None]), (None, 1, ["q"], None, None, None)], SCHEMA.format("seq long, "))
    r = enrich.enrich(s, e).first()
    assert (r.queries, r.vectors, r.keywords, r.entities) == (["q"], [None], ["k"], ["cafe_bar"])
    assert enrich.enrich(s.where("false"), e).count() == 0 and enrich.enrich(s, e.where("false")).first().queries == []


# ---- merges ----


def plain_canonical(tomb):
    into = {}
    for a, b in tomb:
        if a is not None and b is not None and a != b:
            into[a] = min(b, into.get(a, b))
    out = {}
    for a in into:
        seen, x = [], a
        while x in into and x not in seen:
            seen.append(x)
            x = into[x]
        out[a] = min(seen[seen.index(x) :]) if x in into else x
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_circles(spark, seed):
    r = random.Random(seed)
    tomb = [(f"n{i:03}", f"n{r.randrange(300):03}") for i in range(120 + 60 * seed)] + [("n005", "n005"), (None, "n001"), ("n001", None)]
    got = {x.id: x.canonical for x in merges.canonical_ids(spark.createDataFrame(tomb, "id string, into string")).collect()}
    assert got == plain_canonical(tomb)


def test_a_long_chain_a_hub_and_a_circle(spark):
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1000)]
    hub = [(f"h{i:05}", "c0000") for i in range(5000)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("tail", "r3"), ("tail2", "tail")]
    tomb = spark.createDataFrame(chain + hub + ring, "id string, into string")
    got = {x.id: x.canonical for x in merges.canonical_ids(tomb).collect()}
    assert len(got) == 6009 and {got[i] for i, _ in chain + hub} == {"c1000"} and {got[i] for i, _ in ring} == {"r0"}
    assert merges.canonical_ids(tomb.where("false")).count() == 0


def test_proposals_by_hand(spark):
    tomb = spark.createDataFrame([("x1", "x2"), ("x2", "x"), ("gone", "nobody")], "id string, into string")
    ents = spark.createDataFrame([("x", "active"), ("y", "active"), ("z", "active"), ("w", "deleted")], "id string, status string")
    trip = spark.createDataFrame([("x", "z", None), ("y", "z", "2020")], "subject string, object string, valid_to string")
    p = [("x1", "y", 0.5, "f1"), ("y", "x", 0.9, "f1"), ("x2", "y", None, "f2"), ("x1", "x", 0.5, "f1"), ("x1", "z", 0.5, "f1"), ("w", "x", 0.5, "f1"), ("gone", "x", 0.5, "f1"), (None, "x", 0.5, "f1"), ("z", "y", 0.4, "f1")]
    props = spark.createDataFrame(p, "a string, b string, w double, ctx string")
    got = {(r.from_given, r.to_given, r.ctx): r.verdict for r in merges.judge_proposals(props, ents, tomb, trip).collect()}
    assert got == {
        ("x1", "y", "f1"): "repeated", ("y", "x", "f1"): "inserted", ("x2", "y", "f2"): "inserted", ("x1", "x", "f1"): "self_loop", ("x1", "z", "f1"): "connected",
        ("w", "x", "f1"): "phantom", ("gone", "x", "f1"): "phantom", (None, "x", "f1"): "phantom", ("z", "y", "f1"): "inserted",
    }
    made = {(r.from_entity, r.to_entity): (round(r.score, 6), r.shared_context_count) for r in merges.propose_edges(props, ents, tomb, trip).collect()}
    assert made == {("x", "y"): (1.6, 2), ("y", "z"): (0.4, 1)}


def test_patterns_are_searched_only_where_their_cues_stand(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from tessera.functions import lexicons as X
    from tessera.functions import text as T

    patterns = [p for m in X.MARKERS.values() for p in m]
    assert sum(bool(T.cues(p)) for p in patterns) == len(patterns)
    assert [T.cues(p) for p in (r"\b(bug|fail)\b", r"ab*c", r"ab+", r"a|b", r"(?i)abc", r"\Qa\E", r"x{2}", r"\*[^*]+\*", r"(abc)?d", r"(ab|)")] == [["bug", "fail"], ["a"], ["ab"], [], [], [], [], ["*"], ["d"], []]
    rng = random.Random(1)
    words = [w for p in patterns for w in re.split(r"\\.|[^a-z' ]+", p) if w.strip()] + ["v2.1", "10x faster", "5% better", "*so*", "snakecase", "lets use", "don't use"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string")
    rows = df.select("t", *(F.struct(T.marker_score("t", [p], lowered=True), F.regexp_count("t", F.lit(p))).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for k in range(len(patterns)):
        assert all(r[f"p{k}"][0] == r[f"p{k}"][1] for r in rows), patterns[k]
    assert sum(r[f"p{k}"][1] or 0 for r in rows for k in range(len(patterns))) > 500
    plan = T.memory_types(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan
