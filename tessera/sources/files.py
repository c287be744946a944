"""Sources: file scans with ignore rules, transcripts from chat exports, chunkers, JSON lines.

Files come through Spark's readers (``binaryFile``, ``text``), so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a scan reads and skips.
READABLE = [
    ".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv",
    ".sql", ".toml",
]
CONVERSATIONS = [".txt", ".md", ".json", ".jsonl"]
SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", ".pytest_cache"]
MAX_FILE_SIZE = 10 * 1024 * 1024
CHUNK, OVERLAP, LEAST_CHUNK, LEAST_EXCHANGE = 800, 100, 50, 30


def ignore_rules(text: str) -> list[tuple[bool, bool, bool, str]]:
    """Rules of an ignore file in order: (negated, only directories, anchored, pattern as a regular expression)."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if not line:
            continue
        regex = ""
        k = 0
        while k < len(line):
            if line.startswith("**/", k):
                regex, k = regex + "(?:[^/]+/)*", k + 3
            elif line.startswith("/**", k) and k + 3 == len(line):
                regex, k = regex + "/.+", k + 3
            elif line[k] == "*":
                regex, k = regex + "[^/]*", k + 1
            elif line[k] == "?":
                regex, k = regex + "[^/]", k + 1
            else:
                regex, k = regex + re.escape(line[k]), k + 1
        out.append((negated, only_dirs, anchored, regex))
    return out


def is_ignored(path: str, rules: list[tuple[bool, bool, bool, str]], is_dir: bool = False) -> bool:
    """The last rule that matches the path decides; a path below an ignored directory is ignored."""
    parts = path.strip("/").split("/")
    for n in range(1, len(parts) + 1):
        sub, directory = "/".join(parts[:n]), n < len(parts) or is_dir
        verdict = False
        for negated, only_dirs, anchored, regex in rules:
            if only_dirs and not directory:
                continue
            target = sub if anchored else parts[n - 1]
            if re.fullmatch(regex, target):
                verdict = not negated
        if verdict:
            return True
    return False


def ignored(path: str | Column, rules: list[tuple[bool, bool, bool, str]]) -> Column:
    """``is_ignored`` as an Arrow function; the rules travel with it."""

    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else is_ignored(p, rules))

    return run(path)


def forced(path: str | Column, include: list[str]) -> Column:
    """Whether a path is an included one, below one, or above one."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for i in (x.strip("/") for x in include):
        out = out | (p == i) | p.startswith(f"{i}/") | F.startswith(F.lit(i), F.concat(p, F.lit("/")))
    return out


def scan_files(
    spark: SparkSession, root: str, suffixes: list[str] = READABLE, rules: list | None = None, include: list[str] = (), skip_dirs: list[str] = SKIP_DIRS
) -> DataFrame:
    """(path, rel, length, modified, content) below ``root``: readable, not ignored unless included, not over the size limit."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    base = re.sub("^[a-z0-9+.-]+:/*", "/", root).rstrip("/")
    rel = F.substr("path", F.instr("path", base) + len(base) + 1)
    df = df.withColumn("rel", rel)
    df = df.where((F.col("length") <= MAX_FILE_SIZE) & F.lower("rel").rlike(r"(?:%s)$" % "|".join(re.escape(s) for s in suffixes)))
    df = df.where(~F.lower("rel").endswith(".meta.json"))
    for d in skip_dirs:
        df = df.where(~F.concat(F.lit("/"), F.col("rel")).contains(f"/{d}/") | forced("rel", list(include)))
    if rules:
        df = df.where(~ignored("rel", rules) | forced("rel", list(include)))
    return df.select("path", "rel", "length", F.col("modificationTime").alias("modified"), "content")


def not_mined(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest (source_file, mtime) doesn't hold in this or a later state."""
    seen = manifest.select(F.col("source_file").alias("rel"), F.col("mtime").alias("__mtime"))
    return files.join(seen, (files["rel"] == seen["rel"]) & (seen["__mtime"] >= files["modified"]), "left_anti")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# ---- transcripts ----


def _text(content) -> str:
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, list):
        return " ".join(x if isinstance(x, str) else x.get("text", "") for x in content if isinstance(x, str) or isinstance(x, dict) and x.get("type", "text") == "text").strip()
    if isinstance(content, dict):
        return str(content.get("text", "")).strip()
    return ""


ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}


def _pairs(items) -> list[tuple[str, str]]:
    out = []
    for m in items if isinstance(items, list) else []:
        if isinstance(m, dict) and (role := ROLES.get(m.get("role") or m.get("sender") or "")) and (t := _text(m.get("content", m.get("text", "")))):
            out.append((role, t))
    return out


def _agent_lines(text: str) -> list[tuple[str, str]]:
    """One agent's log: lines of type human, user or assistant with a message."""
    out = []
    for o in _objects(text):
        role = ROLES.get(o.get("type", ""))
        if role and isinstance(o.get("message"), dict) and (t := _text(o["message"].get("content", ""))):
            out.append((role, t))
    return out


def _event_lines(text: str) -> list[tuple[str, str]]:
    """Another agent's log: event messages, only with a session line."""
    objects = list(_objects(text))
    if not any(o.get("type") == "session_meta" for o in objects):
        return []
    kinds = {"user_message": "user", "agent_message": "assistant"}
    payloads = [o["payload"] for o in objects if o.get("type") == "event_msg" and isinstance(o.get("payload"), dict)]
    return [(kinds[p["type"]], p["message"].strip()) for p in payloads if p.get("type") in kinds and isinstance(p.get("message"), str) and p["message"].strip()]


def _objects(text: str) -> Iterator[dict]:
    for line in text.splitlines():
        try:
            o = json.loads(line)
        except ValueError:
            continue
        if isinstance(o, dict):
            yield o


def _chat(data) -> list[tuple[str, str]]:
    if isinstance(data, dict):
        return _pairs(data.get("messages") or data.get("chat_messages"))
    if isinstance(data, list) and any(isinstance(x, dict) and "chat_messages" in x for x in data):
        return [p for x in data if isinstance(x, dict) for p in _pairs(x.get("chat_messages"))]
    return _pairs(data)


def _tree(data) -> list[tuple[str, str]]:
    """A map of nodes: from the root along the first child, each node once."""
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return []
    root = next((k for k, n in nodes.items() if n.get("parent") is None and n.get("message") is None), None)
    root = root or next((k for k, n in nodes.items() if n.get("parent") is None), None)
    out, seen = [], set()
    while root in nodes and root not in seen:
        seen.add(root)
        m = nodes[root].get("message")
        if m:
            role = ROLES.get((m.get("author") or {}).get("role", ""))
            t = _text([p for p in (m.get("content") or {}).get("parts", []) if isinstance(p, str)])
            if role and t:
                out.append((role, t))
        root = next(iter(nodes[root].get("children") or []), None)
    return out


def _channel(data) -> list[tuple[str, str]]:
    """Messages of a channel; speakers take turns as user and assistant at first sight."""
    if not isinstance(data, list):
        return []
    roles: dict[str, str] = {}
    out = []
    for m in data:
        if isinstance(m, dict) and m.get("type") == "message" and (t := str(m.get("text", "")).strip()):
            who = m.get("user") or m.get("username") or ""
            roles.setdefault(who, "assistant" if len(roles) % 2 else "user")
            out.append((roles[who], t))
    return out


def to_transcript(messages: list[tuple[str, str]]) -> str:
    """Lines: questions after `> `, answers, a blank line after each exchange."""
    out = []
    for k, (role, text) in enumerate(messages):
        if role == "user":
            out.append("> " + text.replace("\n", " "))
            if k + 1 == len(messages) or messages[k + 1][0] == "user":
                out.append("")
        else:
            out += [text, ""]
    return "\n".join(out).strip() + "\n" if out else ""


def normalize_text(text: str) -> str:
    """Transcript of any known export; other texts as they are."""
    if sum(line.strip().startswith(">") for line in text.split("\n")) >= 3:
        return text
    head = text.lstrip()[:1]
    if head in ("{", "["):
        for read in (_agent_lines, _event_lines):
            if len(m := read(text)) >= 2:
                return to_transcript(m)
        try:
            data = json.loads(text)
        except ValueError:
            return text
        for read in (_tree, _chat, _channel):
            if len(m := read(data)) >= 2:
                return to_transcript(m)
    return text


def normalize(text: str | Column) -> Column:
    """``normalize_text`` as an Arrow function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize_text(t))

    return run(text)


def transcripts(messages: DataFrame) -> DataFrame:
    """(conv_id, transcript) from turns (conv_id, turn, role, text); other roles are left out."""
    m = messages.where(F.col("role").isin("user", "assistant"))
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("> "), F.regexp_replace("text", "\n", " "), F.when(after.isNull() | (after == "user"), "\n").otherwise("")))
    m = m.withColumn("line", line.otherwise(F.concat("text", F.lit("\n"))))
    turns = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return m.groupBy("conv_id").agg(F.concat(F.trim(F.array_join(F.transform(turns, lambda x: x["line"]), "\n"), F.lit("\n ")), F.lit("\n")).alias("transcript"))


# ---- chunkers ----


def chunk_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST_CHUNK) -> list[str]:
    """Pieces of ``size`` characters that end at a paragraph, else a line, in their second half; each starts ``overlap`` before the last end."""
    text = text.strip()
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at
                    break
        piece = text[start:end].strip()
        if len(piece) >= least:
            out.append(piece)
        start = end - overlap if end < len(text) else end
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chunk_index, content) for every document, in Arrow batches."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf[id_col], pdf[text_col]) if t for k, c in enumerate(chunk_text(t))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_index int, content string")


def exchanges(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_EXCHANGE, most_lines: int = 8) -> DataFrame:
    """(id_col, chunk_index, content): a question line and the first answer lines up to the next question or rule.

    For texts with three question lines or more; a running count of questions numbers the exchanges.
    """
    start = lambda x: F.startswith(F.trim(x), F.lit(">"))
    lines = F.split(F.col(text_col), "\n")
    many = docs.where(F.size(F.filter(lines, start)) >= 3)
    each = many.select(id_col, F.posexplode(lines).alias("pos", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    each = each.withColumn("q", F.sum(start(F.col("line")).cast("int")).over(w)).where("q > 0")
    cut = F.max(F.startswith("line", F.lit("---")).cast("int")).over(Window.partitionBy(id_col, "q").orderBy("pos"))
    each = each.withColumn("cut", cut).where("cut = 0 AND line <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    out = each.groupBy(id_col, "q").agg(parts.alias("parts"))
    answer = F.array_join(F.slice("parts", 2, most_lines), " ")
    content = F.concat(F.get("parts", F.lit(0)), F.when(answer != "", F.concat(F.lit("\n"), answer)).otherwise(""))
    out = out.withColumn("content", content).where(F.length("content") > least)
    return out.withColumn("chunk_index", F.row_number().over(Window.partitionBy(id_col).orderBy("q")) - 1).select(id_col, "chunk_index", "content")


def paragraphs(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_EXCHANGE, group: int = 25) -> DataFrame:
    """(id_col, chunk_index, content): paragraphs, or groups of 25 lines where there is one long paragraph only."""
    t = F.col(text_col)
    trim = lambda x: F.trim(x, F.lit(" \n\t\r"))
    paras = F.filter(F.transform(F.split(t, "\n\n"), trim), lambda x: x != "")
    lines = F.split(t, "\n")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / group).cast("int")), lambda k: trim(F.array_join(F.slice(lines, k * group + 1, group), "\n")))
    single = (F.size(paras) <= 1) & (F.size(lines) > 21)
    pieces = F.filter(F.when(single, groups).otherwise(paras), lambda x: F.length(x) > least)
    return docs.where(t.isNotNull()).select(id_col, F.posexplode(pieces).alias("chunk_index", "content"))


def split_sessions(files: DataFrame, header: str, restored: str, id_col: str = "path", ahead: int = 6, least: int = 10) -> DataFrame:
    """(id_col, session, text) of concatenated transcripts.

    A session starts at a header line that no restore marker follows within ``ahead`` lines.  Files with one
    start only stay whole and aren't returned; pieces under ``least`` lines are dropped.
    """
    each = files.select(id_col, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    near = F.max(F.col("line").rlike(restored).cast("int")).over(w.rowsBetween(0, ahead - 1))
    each = each.withColumn("start", (F.col("line").rlike(header) & (near == 0)).cast("int"))
    each = each.withColumn("session", F.sum("start").over(w)).withColumn("n", F.sum("start").over(Window.partitionBy(id_col)))
    each = each.where("n >= 2 AND session > 0")
    out = each.groupBy(id_col, "session").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).where(F.size("l") >= least)
    return out.select(id_col, "session", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def mine(files: DataFrame, agent: str, filed_at: str) -> DataFrame:
    """Records of files (rel, content): chunks with hashed ids, classified."""
    from tessera.functions.text import detect_content_type, record_id

    docs = files.select(F.col("rel").alias("source_file"), F.decode("content", "UTF-8").alias("text"))
    c = chunks(docs, "source_file", "text")
    return c.select(
        record_id(F.lit(agent), "source_file", "chunk_index").alias("id"), F.col("content").alias("text"), "source_file", "chunk_index",
        F.lit(agent).alias("added_by"), detect_content_type("content").alias("content_type"), F.lit(filed_at).alias("filed_at"),
    )
