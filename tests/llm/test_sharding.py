import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.sharding import SHARDS, SLOTS, fill, op1_shard_lookup, place, preferences

NAMES = [f"shard-{i}" for i in range(7)]


def brute(names, slots):
    """Turn by turn, over explicit preference lists."""
    lists = []
    for n in names:
        offset, stride = preferences(n, slots)
        lists.append([(offset + j * stride) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(lists):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = i
    return [owner[s] for s in range(slots)]


def test_fill_is_turn_taking():
    assert fill(NAMES, 251) == brute(NAMES, 251)


def test_shares_differ_by_one_slot():
    t = fill(NAMES, 2003)
    sizes = [t.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_removing_a_shard_moves_few_slots():
    a, b = fill(NAMES, 2003), fill(NAMES[:-1], 2003)
    kept = [x == y for x, y in zip(a, b) if x < 6]
    assert sum(kept) / len(kept) > 0.75


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            fill(names, slots)


def test_place(spark, odd, empty):
    out = place(odd.withColumn("slot", F.lit(9)), "doc_id", NAMES, 251)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    assert out.where("doc_id = 6").select("shard").distinct().count() == 1
    assert out.where("shard IS NULL OR shard < 0 OR shard > 6").count() == 0
    assert place(empty, "doc_id", NAMES, 251).count() == 0


def test_hot_key_is_spread(spark):
    df = spark.range(2000).withColumn("source", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), "id")))
    one = place(df, "source", NAMES, 251).where("source = 'hot'").select("shard").distinct().count()
    many = place(df, "source", NAMES, 251, spread=["id"], hot_share=0.2).where("source = 'hot'").select("shard").distinct().count()
    assert one == 1 and many == 7


def test_native_plan(spark, odd):
    plan = place(odd, "doc_id", NAMES, 251)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Broadcast" in plan


def test_query_against_brute_force(spark, sf):
    """Every document's slot and shard, by hashing in Python and taking turns over explicit orders."""
    names = [f"shard-{i:03d}" for i in range(SHARDS)]
    orders = []
    for n in names:
        offset, stride = preferences(n, SLOTS)
        orders.append(iter([(offset + j * stride) % SLOTS for j in range(SLOTS)]))
    owner = {}
    while len(owner) < SLOTS:
        for i, order in enumerate(orders):
            free = next((x for x in order if x not in owner), None)
            if free is not None:
                owner[free] = i
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op1_shard_lookup(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % SLOTS
        assert (r.slot, r.shard, r.n_bytes) == (slot, owner[slot], len((docs[r.doc_id] or "").encode()))
