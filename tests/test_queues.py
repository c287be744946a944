"""Queues over tables and over streams, restarts included."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.folds import keyed_fold
from tessera.plans import queue_queries as Q
from tessera.streaming import queues


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def rocks(spark):
    for k, v in queues.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in queues.STATE_STORE:
        spark.conf.unset(k)


def in_files(df, order, folder, n):
    """The rows in n files, in order of time."""
    values = sorted(r[0] for r in df.select(order).distinct().collect())
    cuts = [values[len(values) * i // n] for i in range(n)]
    for i, low in enumerate(cuts):
        part = df.where(F.col(order) >= F.lit(low))
        part = part.where(F.col(order) < F.lit(cuts[i + 1])) if i + 1 < n else part
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(n)]


def stepwise(spark, parts, schema, make, tmp_path):
    """Runs a stream anew for every part, as after a restart, from one checkpoint; all rows it gave."""
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    for p in parts:
        spark.read.parquet(p).write.mode("append").parquet(source)
        found = make(spark.readStream.schema(schema).parquet(source))
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return rows(spark.read.parquet(out))


def test_cues_by_hand(spark):
    """One cue serves one call, by tool and age; cues without a time stay; calls without one let none expire."""
    s = 1_000_000
    e = [
        ("a", False, "x", 1, 0), ("a", False, "x", 2, 0), ("a", True, "x", 3, 10 * s), ("a", True, "x", 4, 20 * s), ("a", True, "x", 5, 30 * s),
        ("b", False, "x", 1, 0), ("b", False, "y", 2, 250 * s), ("b", True, "y", 3, 301 * s), ("b", True, "x", 4, 302 * s),
        ("c", False, "x", 1, 0), ("c", True, "x", 2, 300 * s), ("d", False, "x", 1, None), ("d", True, "x", 2, 9_000 * s), (None, True, "x", 1, 0),
        ("f", False, "x", 9, 0), ("f", True, "x", 1, 0), ("g", True, "x", 1, None), ("g", False, "x", 2, 0), ("h", False, None, 1, 0), ("h", True, None, 2, 1),
    ]
    got = {(r.session, r.call_id): (r.cue_id, r.n_expired) for r in queues.consume_cues(spark.createDataFrame(e, queues.CUE_EVENT).repartition(3)).collect()}
    assert got == {
        ("a", 3): (1, 0), ("a", 4): (2, 0), ("a", 5): (None, 0), ("b", 3): (2, 1), ("b", 4): (None, 0), ("c", 2): (1, 0), ("d", 2): (1, 0), (None, 1): (None, 0),
        ("f", 1): (9, 0), ("g", 1): (None, 0), ("h", 2): (1, 0),
    }


def test_no_cue_twice(spark, sf):
    used = [r.cue_id for r in Q.stream_consume_cues(spark, sf).collect() if r.cue_id >= 0]
    assert used and len(used) == len(set(used))


def test_cues_as_a_stream_across_restarts(rocks, sf, tmp_path):
    """Events in four files, the stream started anew for each: the rows of the table."""
    spark = rocks
    e = spark.read.parquet(f"{sf}/events.parquet")
    ttl = 3 * 3600
    want = rows(queues.consume_cues(Q.cue_events(e), ttl))
    got = stepwise(spark, in_files(e, "ts", str(tmp_path / "in"), 4), e.schema, lambda s: queues.consume_cues_stream(Q.cue_events(s), ttl), tmp_path)
    assert got == want and any(r[3] is not None for r in got)


def test_messages_by_hand(spark):
    e = [
        ("a", 1, "append", "m1", "one"), ("a", 2, "append", "m1", "again"), ("a", 3, "append", "m2", None), ("a", 4, "remove", "m1", None), ("a", 5, "append", "m1", "anew"),
        ("a", 6, "clear", None, None), ("a", 7, "append", "m3", "late"), ("a", 8, "append", "", "no id"), ("a", 9, "other", "m3", None), ("b", 1, "clear", None, None), ("b", 2, "remove", "m9", None),
    ]
    got = rows(queues.drain_messages(spark.createDataFrame(e, queues.MESSAGE_EVENT)))
    assert got == [("a", "m1", "anew", 2, 5, 6), ("a", "m1", "one", 0, 1, 4), ("a", "m2", "", 1, 3, 6)]


def test_messages_as_a_stream_across_restarts(rocks, sf, tmp_path):
    spark = rocks
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    got = stepwise(spark, in_files(c, "turn", str(tmp_path / "in"), 3), c.schema, lambda s: queues.drain_messages_stream(Q.message_events(s)), tmp_path)
    assert got == rows(queues.drain_messages(Q.message_events(c))) and got


def test_fold_of_a_long_run(spark):
    """A key with most rows passes in slices; nulls are a key; no rows give none."""

    class Sum:
        def __init__(self):
            self.n, self.last = 0, None

        def row(self, r):
            assert self.last is None or r["v"] >= self.last
            self.n, self.last = self.n + 1, r["v"]
            return []

        def end(self):
            return [(self.n, self.last)]

    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 20_000).alias("v"))
    got = rows(keyed_fold(df, ["k"], ["v"], Sum, "n long, last long"))
    assert sorted(n for n, _ in got) == [666, 667, 667, 18_000]
    assert keyed_fold(df.where("false"), ["k"], ["v"], Sum, "n long, last long").count() == 0
