"""Steps whose cost must not grow faster than their input: what their plans may hold, and that their rows stay the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, kg, merges, ranking, search, vector
from tessera.plans import rank_queries

_FACT = "id string, subject string, predicate string, object string, valid_from string, valid_to string"


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def _facts(spark, n):
    return spark.createDataFrame([(f"t{i:03}", "x" if i < n - 20 else "a", "is_a", "b", f"20{i:03}", None) for i in range(n)], _FACT)


def test_timeline_names_only_the_oldest(spark, no_broadcast):
    e = spark.createDataFrame([("a", "A"), ("b", "B"), ("x", "X")], "id string, name string")
    out = kg.timeline(_facts(spark, 60), e, limit=10)
    assert [r["triple_id"] for r in out.collect()] == [f"t{i:03}" for i in range(10)]
    assert "Join" not in _plan(out)


def test_timeline_goes_on_where_the_oldest_have_no_names(spark):
    e = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert [r["triple_id"] for r in kg.timeline(_facts(spark, 100), e, limit=10).collect()] == [f"t{i:03}" for i in range(80, 90)]
    assert kg.timeline(_facts(spark, 30), e, limit=10).count() == 10 and kg.timeline(_facts(spark, 30), e, limit=25).count() == 20


def test_missing_endpoints_reads_facts_once(spark, no_broadcast):
    facts = spark.createDataFrame([("t1", "a", "p", "b", None, None), ("t2", "c", "p", "c", None, None), ("t3", None, "p", "a", None, None)], _FACT)
    e = spark.createDataFrame([("a", "active"), ("b", "deleted")], "id string, status string")
    out = kg.missing_endpoints(facts, e)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("t1", "b"), ("t2", "c"), ("t2", "c"), ("t3", None)], key=str)
    assert _plan(out).count("LeftAnti") == 1


def test_closure_deals_settled_rows_by_their_id(spark, no_broadcast):
    facts = spark.createDataFrame([(f"t{i}", f"e{i}", "is_a", f"e{i // 2}", None, None) for i in range(1, 40)], _FACT)
    out = kg.closure(facts, facts.selectExpr("subject AS id"))
    want = {}
    for i in range(1, 40):
        at = i
        for d in range(6):
            want.setdefault((f"e{i}", f"e{at}"), d)
            if at == 0:
                break
            at //= 2
    assert {(r["id"], r["ancestor"]): r["depth"] for r in out.collect()} == want
    assert "ELSE id" in _plan(out)


def test_chains_take_rounds_by_their_length(spark, monkeypatch):
    into = {f"c{i:04}": f"c{i - 1:04}" for i in range(3000) if i % 4}  # chains of three
    into |= {f"r{i:02}": f"r{(i + 1) % 5 if i < 5 else i - 1:02}" for i in range(40)}  # a circle of five with a tail of 35
    into |= {"z1": "z2", "z2": "z3", "z3": "z1"}
    cuts, cut = [], merges._cut
    monkeypatch.setattr(merges, "_cut", lambda df: cuts.append(1) or cut(df))
    found = merges.canonical_ids(spark.createDataFrame(list(into.items()), "id string, into string"))

    def end(x):
        seen = []
        while x in into and x not in seen:
            seen.append(x)
            x = into[x]
        return min(seen[seen.index(x) :]) if x in seen else x

    assert {r["id"]: r["canonical"] for r in found.collect()} == {x: end(x) for x in into}
    del cuts[:]
    plain = [(x, y) for x, y in into.items() if x[0] != "r"]
    assert merges.canonical_ids(spark.createDataFrame(plain, "id string, into string")).count() == len(plain)
    assert len(cuts) < 13  # not one for every doubling of their number


def test_proposals_of_a_context_meet_once(spark, no_broadcast):
    rows = [("a", "b", 0.5, "x"), ("b", "m", 0.9, "x"), ("a", "b", 0.5, "y"), ("a", "m", None, "y"), ("a", "q", 0.1, "x"), ("d", "a", 0.2, "x"), ("m", "a", 0.3, "z"), ("b", "c", 0.3, "z")]
    e = spark.createDataFrame([(x, "active" if x != "d" else "deleted") for x in "abcdm"], "id string, status string")
    tomb = spark.createDataFrame([("m", "a"), ("q", "d")], "id string, into string")
    out = merges.judge_proposals(spark.createDataFrame(rows, "a string, b string, w double, ctx string"), e, tomb, spark.createDataFrame([("t", "c", "p", "b", None, None)], _FACT))
    got = sorted((r["from_given"], r["to_given"], r["ctx"], r["verdict"]) for r in out.collect())
    assert got == sorted([
        ("a", "b", "x", "repeated"), ("b", "m", "x", "inserted"), ("a", "b", "y", "inserted"), ("a", "m", "y", "self_loop"),
        ("a", "q", "x", "phantom"), ("d", "a", "x", "phantom"), ("m", "a", "z", "self_loop"), ("b", "c", "z", "connected"),
    ])
    assert _plan(out).count("Window [") == 1  # pairs of a context meet once, without a join back


def test_closings_stream_past_the_last_of_each_run(spark, no_broadcast):
    opened = spark.createDataFrame([(1, "s", "m"), (2, "s", "m"), (3, "s", "m"), (4, "s", "m")], "run_id long, started_ts string, model string")
    rows = [(1, 1, "b"), (1, 5, "a"), (1, 2, "b"), (2, None, "a"), (2, 1, None), (3, 7, None), (3, 8, None), (None, 1, "a"), (9, 1, "z")]
    closed = spark.createDataFrame([(r, s, t, [s], {"merges": s or 0}, 0, "") for r, s, t in rows], "run_id long, seq long, ts string, flag_ids array<long>, counters map<string,int>, exit_code int, errors string")
    out = changes.close_runs(opened, closed)
    assert {r["run_id"]: (r["completed_ts"], r["flag_ids"], r["merges"]) for r in out.collect()} == {1: ("b", [2], 2), 2: ("a", [None], 0), 3: (None, [8], 8), 4: (None, None, None)}
    assert "ShuffledHashJoin" in _plan(out)


def test_blocks_send_only_what_may_still_be_near(spark):
    v = spark.range(12_000, numPartitions=1).selectExpr("id", "array(1D, id / 1000D) AS embedding")
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id long, view int, query array<double>")
    assert [r["id"] for r in vector.cosine_top_k(q, v, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert vector._compared(q, v, 5).count() < 10  # later blocks of a task know what the first ones have


def test_embedder_is_that_of_single_texts(spark):
    import numpy as np
    import xxhash

    def one(t):
        v = np.zeros(8)
        for w in (t or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            v[h % 8] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    texts = ["a b c", None, "", "Word word other", "x " * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", vector.hashing_embedder(8)("t").alias("e")).collect()
    assert [r["e"] for r in got] == [one(t) for t in texts]


def _fusable(ids, similarity):
    low = np.flatnonzero(similarity < 0.5)
    return [("view_0", 1.0, np.flatnonzero(similarity > -0.2), similarity[similarity > -0.2]), ("low", 0.5, low, np.round(similarity[low], 1))]


def test_fusion_where_a_query_meets_the_vectors(spark):
    rng = np.random.default_rng(4)
    v = [(None if i in (7, 8) else i // 2 if 60 < i < 80 else 200 - i, None if i == 9 else [1.0] if i == 11 else [0.0] * 3 if i == 12 else rng.normal(size=3).tolist()) for i in range(200)]
    q = [(i % 40, i // 40, None if i == 3 else rng.normal(size=3).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(v, "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(q, "query_id int, view int, query array<double>")
    s = vector.score_queries(queries, vectors).groupBy("query_id", "id").agg(F.max("similarity").alias("s"))
    row = lambda df, name, w, score: df.select("query_id", F.lit(name).alias("list_name"), F.lit(w).alias("weight"), "id", score.alias("score"))
    plain = row(s.where("s > -0.2"), "view_0", 1.0, F.col("s")).unionByName(row(s.where("s < 0.5"), "low", 0.5, F.bround("s", 1)))
    want = {(r.query_id, r.id): (r.channels, r.primary, pytest.approx(r.rrf, abs=1e-12)) for r in ranking.rrf(plain).collect()}
    out = search.fused(queries, vectors, _fusable, places=15)
    assert {(r.query_id, r.id): (r.channels, r.primary, r.rrf) for r in out.collect()} == want and len(want) > 5000
    assert out.rdd.getNumPartitions() > 1
    first = {x: [r.id for r in sorted((r for r in out.collect() if r.query_id == x), key=lambda r: (-r.rrf, r.id is not None, r.id))[:7]] for x in range(40)}
    few = search.fused(queries, vectors, _fusable, pool=7, places=15).collect()
    assert {x: sorted((r.id for r in few if r.query_id == x), key=str) for x in range(40)} == {x: sorted(y, key=str) for x, y in first.items()}
    assert search.fused(queries.limit(0), vectors, _fusable).count() == 0 == search.fused(queries, vectors.limit(0), _fusable).count()


@pytest.mark.parametrize("name", ["rank_rrf", "rank_two_stage"])
def test_fusion_shuffles_vectors_and_no_pairs(spark, sf, name):
    plan = _plan(rank_queries.QUERIES[name](spark, sf))
    below = plan[plan.index("MapInArrow") :]
    assert below.count("Exchange") == 1 and "Window" not in below and "Aggregate" not in plan


def test_rounding_is_half_up():
    assert ranking.half_up(np.array([0.0002734375, 0.5, -0.5, 1.25, -0.0, 0.1234565]), 9).tolist() == [0.000273438, 0.5, -0.5, 1.25, 0.0, 0.1234565]
    assert ranking.half_up(np.array([0.5, 1.5, 2.5, -2.5]), 0).tolist() == [1.0, 2.0, 3.0, -3.0]
