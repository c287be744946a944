"""Actions on tables, change logs, ingest across runs and spelling, against plain evaluations."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, spelling
from tessera.streaming import changelog


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- flags, runs, contents ----


def test_flag_actions_one_by_one(spark):
    r = random.Random(2)
    at = lambda i: datetime(2024, 1, 1) + timedelta(minutes=i)
    queue = [(f, r.randint(0, 2), None, at(0) if f % 7 == 0 else None, "merged" if f % 7 == 0 else None, "old" if f % 7 == 0 else None, f"more {f}") for f in range(40)]
    acts = [(r.randrange(45), s, at(r.randrange(30)), r.choice(["bump", "bump", "resolve", "other"]), r.choice(["merged", "pruned", "nonsense", None]), r.choice(["why", None])) for s in range(200)]
    q = spark.createDataFrame(queue, "flag_id long, attempted_count int, last_attempt_ts timestamp, resolved_ts timestamp, resolution string, resolution_note string, more string")
    a = spark.createDataFrame(acts, "flag_id long, seq long, ts timestamp, action string, resolution string, note string")
    want = {x[0]: list(x) for x in queue}
    for f, _, ts, action, resolution, note in sorted(acts, key=lambda x: (x[2], x[1])):
        x = want.get(f)
        if x is None or x[3] is not None or action == "other" or action == "resolve" and resolution not in changes.RESOLUTIONS:
            continue
        x[1], x[2] = x[1] + 1, ts
        if action == "resolve":
            x[3], x[4], x[5] = ts, resolution, note or ""
    got = changes.apply_flag_actions(q, a)
    assert got.columns == q.columns and rows(got) == sorted((tuple(x) for x in want.values()), key=repr)
    assert rows(changes.apply_flag_actions(q, a.where("false"))) == rows(q) and changes.apply_flag_actions(q.where("false"), a).count() == 0


def test_runs(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    opened = spark.createDataFrame([(1, t(1), "m"), (2, t(2), "m"), (3, t(3), "m")], "run_id long, started_ts timestamp, model string")
    closed = spark.createDataFrame(
        [(1, 1, t(4), [7, 8], {"merges": 2}, 0, None), (1, 2, t(5), [9], {"prunes": 1, "other": 5}, 1, "late"), (3, 1, t(4), None, None, None, None), (9, 1, t(4), [1], {}, 0, "")],
        "run_id long, seq long, ts timestamp, flag_ids array<long>, counters map<string,int>, exit_code int, errors string",
    )
    got = {r.run_id: r for r in changes.close_runs(opened, closed).collect()}
    assert set(got) == {1, 2, 3} and got[2].completed_ts is None and got[2].merges is None and got[2].flags_processed is None
    assert (got[1].completed_ts, got[1].flags_processed, got[1].merges, got[1].prunes, got[1].exit_code, got[1].errors) == (t(5), 1, 0, 1, 1, "late")
    assert (got[3].flags_processed, got[3].flag_ids, got[3].no_action, got[3].errors) == (0, [], 0, "")


def test_contents(spark):
    e = spark.createDataFrame([("a", "old", 3, "2024-01-01"), ("b", "old", None, None)], "id string, content string, importance int, last_touched string")
    u = spark.createDataFrame([("a", 1, "2024-02-01", "one", 5), ("a", 2, "2024-02-01", "two", None), ("z", 1, "2024-02-01", "no", 1)], "id string, seq long, ts string, content string, importance int")
    assert rows(changes.update_contents(e, u)) == [("a", "two", 5, "2024-02-01"), ("b", "old", None, None)]


# ---- the log ----


def test_an_epoch_that_comes_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    assert changelog.read_log(spark, path, "k string, v int").count() == 0
    sink = changelog.log_sink(path)
    batch = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    sink(batch(("a", 1), ("b", 1)), 0)
    sink(batch(("a", 2)), 1)
    sink(batch(("a", 2)), 1)
    sink(batch(), 2)
    log = changelog.read_log(spark, path, "k string, v int")
    assert rows(log) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
    assert rows(changelog.latest(log, ["k"])) == [("a", 2), ("b", 1)]
    sink(batch(("a", 3), ("c", None)), 1)  # delivered anew with other rows: the last delivery counts
    assert rows(changelog.latest(changelog.read_log(spark, path, "k string, v int"), ["k"])) == [("a", 3), ("b", 1), ("c", None)]


def write(path, text, age):
    path.write_text(text)
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def test_ingest_of_changes(spark, tmp_path):
    root, log = tmp_path / "src", str(tmp_path / "log")
    root.mkdir()
    long = "A paragraph that is long enough to be a chunk of its own, about the first thing. " * 30
    write(root / "a.md", long, 1)
    write(root / "b.txt", "We decided to use the second thing because it is simpler than the first one.", 1)
    write(root / "empty.md", "", 1)
    ingest = lambda: changelog.ingest_changes(spark, str(root), log, "agent", "2024-01-01")
    files = lambda: {r.source_file: r.n for r in changelog.ingested(spark, log).groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    assert ingest() == 0
    first = files()
    assert set(first) == {"a.md", "b.txt"} and first["a.md"] > 2
    assert ingest() == 0 and files() == first  # nothing new, no epoch
    write(root / "a.md", "Now the first file is one short paragraph, still long enough for a chunk of its own.", 2)
    write(root / "c.md", "A third file that comes later, and that is also long enough for a chunk.", 1)
    assert ingest() == 1 and files() == {"a.md": 1, "b.txt": 1, "c.md": 1}
    assert "short paragraph" in changelog.ingested(spark, log).where("source_file = 'a.md'").first().text
    (root / "b.txt").unlink()
    write(root / "c.md", "", 3)
    assert ingest() == 2 and files() == {"a.md": 1}
    assert ingest() == 2
    write(root / "b.txt", "It is back, with other words that are long enough to make a chunk of their own.", 1)
    assert ingest() == 3 and files() == {"a.md": 1, "b.txt": 1}


def test_ingest_as_a_stream_across_restarts(spark, tmp_path):
    root, log, state = tmp_path / "src", str(tmp_path / "log"), str(tmp_path / "state")
    root.mkdir()
    run = lambda: changelog.ingest_stream(spark, str(root), log, "agent", "2024-01-01", state)
    write(root / "a.md", "The first file of the stream, long enough to be a chunk of its own.", 1)
    run()
    write(root / "b.md", "The second file of the stream, long enough to be a chunk of its own.", 2)
    run()
    run()
    got = changelog.ingested(spark, log)
    assert sorted(r.source_file for r in got.collect()) == ["a.md", "b.md"]
    assert {r.epoch for r in changelog.read_log(spark, log, changelog.CHUNK).select("epoch").collect()} == {0, 1}


# ---- spelling ----


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(r, w):
    for _ in range(r.randint(0, 3)):
        i = r.randrange(len(w) + 1)
        w = r.choice([w[:i] + r.choice("abcé") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abc") + w[i + 1 :]])
    return w


def test_suggestions_are_all_within_two_edits(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)} | {"naïve", "日本語", "x" * 24, "x" * 25})
    asked = sorted({changed(r, r.choice(words)) for _ in range(150)} | {"", "日本", "x" * 23})
    index = spark.createDataFrame([(w, i % 5) for i, w in enumerate(words)], "word string, freq int")
    got = {(x.asked, x.word): x.distance for x in spelling.suggestions(spark.createDataFrame([(a,) for a in asked] * 2, "asked string"), spelling.deletion_index(index)).collect()}
    want = {(a, w): distance(a, w) for a in asked for w in words if 0 < len(a) <= 24 and len(w) <= 24 and distance(a, w) <= 2}
    assert got == want
    best = {x.asked: (x.distance, x.corrected) for x in spelling.corrections(spark.createDataFrame([(a,) for a in asked], "asked string"), index).collect()}
    freq = {w: i % 5 for i, w in enumerate(words)}
    for a in asked:
        near = sorted((d, -freq[w], w) for (x, w), d in want.items() if x == a)
        assert best.get(a) == ((near[0][0], near[0][2]) if near and a not in freq else None)


@pytest.mark.parametrize(
    "text,want",
    [
        ("> pleese fix the  tabel,\tnow", "> please fix the  table,\tnow"),
        ("pleese fix\n  > pleese!\n>pleese\n> ", "pleese fix\n  > please!\n>pplease\n> "),  # the sign after > is left alone, whatever it is
        ("> Pleese keep Names and tabel_one and tab3l and TABEL", "> Pleese keep Names and tabel_one and tab3l and TABEL"),
        ("> riley and the\n\n> zzzzzzzz tab", "> riley and the\n\n> zzzzzzzz tab"),
        ("", ""), (None, None),
    ],
)
def test_lines(spark, text, want):
    d = spark.createDataFrame([("please", 9), ("table", 9), ("fix", 9), ("the", 9), ("now", 9), ("rally", 1)], "word string, freq int")
    n = spark.createDataFrame([("Riley",)], "name string")
    got = spelling.correct_lines(spark.createDataFrame([(1, text)], "id int, text string"), d, n).collect()
    assert [tuple(x) for x in got] == [(1, want)]
