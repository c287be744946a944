import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files


@pytest.mark.parametrize(
    "rules, path, want",
    [
        ("*.log", "a/b.log", True), ("*.log\n!keep.log", "a/keep.log", False), ("/build", "build/x.py", True), ("/build", "src/build/x.py", False),
        ("docs/", "docs/a.md", True), ("docs/", "docs", False), ("a/**/z.txt", "a/b/c/z.txt", True), ("a/**/z.txt", "a/z.txt", True),
        ("# note\n\n?.md", "x.md", True), ("?.md", "xy.md", False), ("tmp", "src/tmp/a/b.py", True),
    ],
)
def test_ignore_rules(rules, path, want):
    assert files.is_ignored(path, files.ignore_rules(rules)) is want


def test_scan_and_mine(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f(): pass  # the function of this python module\n" * 40)
    (tmp_path / "src/b.log").write_text("no")
    (tmp_path / "src/c.md").write_text("secret " * 20)
    (tmp_path / "node_modules/d.py").write_text("x" * 100)
    scan = lambda **k: sorted(r.rel for r in files.scan_files(spark, str(tmp_path), **k).select("rel").collect())
    assert scan() == ["src/a.py", "src/c.md"]
    assert scan(rules=files.ignore_rules("*.md")) == ["src/a.py"]
    assert scan(rules=files.ignore_rules("*.md"), include=["src/c.md"]) == ["src/a.py", "src/c.md"]
    rows = files.mine(files.scan_files(spark, str(tmp_path)), "me", "2024-01-01").collect()
    assert {r.source_file for r in rows} == {"src/a.py", "src/c.md"} and all(r.id.startswith("record_me_") and len(r.id) == 34 for r in rows)
    seen = files.scan_files(spark, str(tmp_path)).select(F.col("rel").alias("source_file"), F.col("modified").alias("mtime")).where("source_file = 'src/a.py'")
    assert [r.rel for r in files.not_mined(files.scan_files(spark, str(tmp_path)), seen).collect()] == ["src/c.md"]


def lines(*objects):
    return "\n".join(json.dumps(o) for o in objects)


@pytest.mark.parametrize(
    "text",
    [
        lines({"type": "human", "message": {"content": "q"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}]}}),
        lines({"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}),
        json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]),
        json.dumps({"messages": [{"role": "human", "content": "q"}, {"role": "ai", "content": "a"}]}),
        json.dumps([{"chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "text": "a"}]}]),
        json.dumps({"mapping": {"r": {"parent": None, "message": None, "children": ["1"]}, "1": {"parent": "r", "children": ["2", "9"], "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}}, "2": {"parent": "1", "children": ["1"], "message": {"author": {"role": "assistant"}, "content": {"parts": ["a"]}}}}}),
        json.dumps([{"type": "message", "user": "U1", "text": "q"}, {"type": "message", "user": "U2", "text": "a"}]),
    ],
)
def test_exports_become_transcripts(spark, text):
    assert files.normalize_text(text) == "> q\na\n"
    assert spark.createDataFrame([(text,)], "t string").select(files.normalize("t").alias("x")).first().x == "> q\na\n"


def test_other_texts_stay():
    for t in ("plain", "> a\n> b\n> c", '{"x": 1}', "[1, 2", "[]"):
        assert files.normalize_text(t) == t


def test_chunk_text_by_hand():
    assert files.chunk_text("short") == []
    text = "a" * 500 + "\n\n" + "b" * 600
    got = files.chunk_text(text)
    assert got[0] == "a" * 500 and got[1] == "a" * 100 + "\n\n" + "b" * 600
    assert files.chunk_text("x" * 1700) == ["x" * 800, "x" * 800, "x" * 300]


def test_split_sessions(spark):
    body = ["line"] * 11
    text = "\n".join(["== start", *body, "== start", "restored", *body, "== start", *body, "== start", "x"])
    df = spark.createDataFrame([("f", text), ("g", "== start\n" + "\n".join(body))], "path string, text string")
    got = files.split_sessions(df, "^== start", "^restored").collect()
    assert sorted((r.path, r.session, r.text.count("\n")) for r in got) == [("f", 1, 24), ("f", 2, 11)]


def test_json_lines_drop_malformed(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01", "reused": true}\nnot json\n{"reused": false}\n')
    assert files.json_lines(spark, str(tmp_path / "log.jsonl"), "ts string, reused boolean").count() == 2
