"""Detection of people and projects in texts, and the registry of known names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import once

#: Patterns with {name} in place of the candidate.
PERSON_VERBS = [
    r"\b{name}\s+said\b", r"\b{name}\s+asked\b", r"\b{name}\s+told\b", r"\b{name}\s+replied\b", r"\b{name}\s+laughed\b", r"\b{name}\s+smiled\b",
    r"\b{name}\s+cried\b", r"\b{name}\s+felt\b", r"\b{name}\s+thinks?\b", r"\b{name}\s+wants?\b", r"\b{name}\s+loves?\b", r"\b{name}\s+hates?\b",
    r"\b{name}\s+knows?\b", r"\b{name}\s+decided\b", r"\b{name}\s+pushed\b", r"\b{name}\s+wrote\b", r"\bhey\s+{name}\b", r"\bthanks?\s+{name}\b",
    r"\bhi\s+{name}\b", r"\bdear\s+{name}\b",
]
PRONOUNS = r"\b(?:she|her|hers|he|him|his|they|them|their)\b"
DIALOGUE = [r"^>\s*{name}[:\s]", r"^{name}:\s", r"^\[{name}\]", r'"{name}\s+said']
PROJECT_VERBS = [
    r"\bbuilding\s+{name}\b", r"\bbuilt\s+{name}\b", r"\bship(?:ping|ped)?\s+{name}\b", r"\blaunch(?:ing|ed)?\s+{name}\b",
    r"\bdeploy(?:ing|ed)?\s+{name}\b", r"\binstall(?:ing|ed)?\s+{name}\b", r"\bthe\s+{name}\s+architecture\b", r"\bthe\s+{name}\s+pipeline\b",
    r"\bthe\s+{name}\s+system\b", r"\bthe\s+{name}\s+repo\b", r"\b{name}\s+v\d+\b", r"\b{name}\.py\b", r"\b{name}-core\b", r"\b{name}-local\b",
    r"\bimport\s+{name}\b", r"\bpip\s+install\s+{name}\b",
]
DIRECT = r"\bhey\s+{name}\b|\bthanks?\s+{name}\b|\bhi\s+{name}\b"
VERSIONED = r"\b{name}[-v]\w+"
CODE_REFERENCE = r"\b{name}\.(?:py|js|ts|yaml|yml|json|sh)\b"
CAPS = {"person": 15, "project": 10, "uncertain": 8}


def candidates(docs: DataFrame, stop: list[str] = (), least: int = 3, by: list[str] = ("doc_id",)) -> DataFrame:
    """(by, name, frequency): capitalised words and runs of them, ``least`` times or more in a document, without stop words."""
    one = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{1,19})\b"), F.lit(1))
    many = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), F.lit(1))
    names = docs.select(*by, F.explode(F.concat(one, many)).alias("name"))
    if stop:
        low = F.split(F.lower("name"), r"\s+")
        names = names.where(~F.arrays_overlap(low, F.lit(list(stop))))
    return names.groupBy(*by, "name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def _cues(pattern: str) -> list[str]:
    """Literals of which every match of a pattern holds one, in lower case: the longest of each alternative, '' if it has none."""
    group = re.search(r"\(\?:([^()]*)\)(?!\?)", pattern)
    if group:
        return [c for x in group[1].split("|") for c in _cues(pattern[: group.start()] + x + pattern[group.end() :])]
    plain = re.sub(r"\\[bswd][+*]?|\{name\}|\\(\W)|\[[^\]]*\]|\(\?:[^()]*\)\?|.\?|\^", lambda m: m[1] or "\n", pattern)
    return [max(x.split("\n"), key=len) for x in plain.split("|")]


def _held(pattern: str) -> Column:
    """Whether a text, of which ``__low`` is the lower-case form, has what stands around the name in one of the pattern's alternatives."""
    any_of = F.lit(False)
    for part in [pattern] if "(" in pattern else pattern.split("|"):
        low, (before, after), cued = F.col("__low"), part.split("{name}"), F.lit(False)
        for c in _cues(part):
            cued = cued | low.contains(c)
        for x in (before.removesuffix(r"\b"), after.removeprefix(r"\b")):
            cued = cued & low.rlike(f"(?m){x}") if x else cued
        any_of = any_of | cued
    return any_of


#: Patterns that are searched only in texts that hold a cue of theirs.
_PATTERNS = [*DIALOGUE, *PERSON_VERBS, DIRECT, *PROJECT_VERBS, VERSIONED, CODE_REFERENCE]


def prepared(texts: DataFrame) -> DataFrame:
    """Rows with a text and what ``scores`` asks of it whatever the name: which patterns have a cue in it, and which lines a pronoun."""
    rows = once(texts, __low=F.lower("text"))
    lines = F.transform(F.split("__low", "\n"), lambda x: x.rlike(PRONOUNS))
    rows = once(rows, __cued=F.array(*map(_held, _PATTERNS)), __pronouns=lines)
    return rows.drop("__low")


def _count(pattern: str) -> Column:
    """Matches of a pattern of the row's own name, any case, at line starts too."""
    escaped = F.regexp_replace("name", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    found = F.regexp_count("text", F.replace(F.lit(f"(?im){pattern}"), F.lit("{name}"), escaped))
    held = F.col("__cued")[_PATTERNS.index(pattern)]
    if pattern == VERSIONED:  # most texts have its signs somewhere: look for them behind the name; letters beyond ASCII may change with what follows
        low, name = F.lower("text"), F.lower("name")
        held = held & (F.contains(low, F.concat(name, F.lit("-"))) | F.contains(low, F.concat(name, F.lit("v"))) | F.col("name").rlike("[^ -~]"))
    return F.when(held, found).otherwise(0)


def scores(named: DataFrame) -> DataFrame:
    """Rows (name, frequency, text) with person_score, project_score and the number of kinds of person signals.

    Where many names share a text, join them with its ``prepared`` form, so that it is searched for cues once.
    """
    own = [c for c in named.columns if c not in ("__cued", "__pronouns")]
    rows = named if len(own) < len(named.columns) else prepared(named)
    near = lambda i: F.exists(F.slice("__pronouns", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 3), lambda x: x)
    around = F.transform(F.split(F.lower("text"), "\n"), lambda x, i: near(i) & F.contains(x, F.lower("name")))
    projects = sum((_count(p) for p in PROJECT_VERBS), F.lit(0)) * 2 + _count(VERSIONED) * 3 + _count(CODE_REFERENCE) * 3
    rows = once(
        rows, __dialogue=sum((_count(p) for p in DIALOGUE), F.lit(0)), __verbs=sum((_count(p) for p in PERSON_VERBS), F.lit(0)),
        __pronoun=F.size(F.filter(around, lambda x: x)), __direct=_count(DIRECT), __projects=projects,
    )
    dialogue, verbs, pronoun, direct = (F.col(f"__{k}") for k in ("dialogue", "verbs", "pronoun", "direct"))
    kinds = sum(((c > 0).cast("int") for c in (dialogue, verbs, pronoun, direct)), F.lit(0))
    return rows.select(*own, (dialogue * 3 + verbs * 2 + pronoun * 2 + direct * 4).alias("person_score"), F.col("__projects").alias("project_score"), kinds.alias("kinds"))


def classify(scored: DataFrame) -> DataFrame:
    """type and confidence: person from a ratio of 0.7 with two kinds of signals and a score of 5; project up to 0.3; else uncertain."""
    p, q = F.col("person_score"), F.col("project_score")
    ratio = p / F.nullif(p + q, F.lit(0))
    person = (ratio >= 0.7) & (F.col("kinds") >= 2) & (p >= 5)
    kind = F.when(ratio.isNull(), "uncertain").when(person, "person").when(ratio >= 0.7, "uncertain").when(ratio <= 0.3, "project").otherwise("uncertain")
    conf = (
        F.when(ratio.isNull(), F.least(F.lit(0.4), F.col("frequency") / 50))
        .when(person, F.least(F.lit(0.99), 0.5 + ratio * 0.5))
        .when(ratio >= 0.7, 0.4)
        .when(ratio <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5))
        .otherwise(0.5)
    )
    return scored.withColumn("type", kind).withColumn("confidence", F.round(conf, 2))


def capped(classified: DataFrame, by: list[str], caps: dict[str, int] = CAPS) -> DataFrame:
    """The most confident of each type, as many as its cap."""
    w = Window.partitionBy(*by, "type").orderBy(F.desc("confidence"), F.desc("frequency"), "name")
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("type"))
    return classified.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def lookup(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, type, canonical) of known names, by name or alias in any case; `unknown` else. registry: name, type, aliases."""
    r = registry.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("__k"), "type", F.col("name").alias("canonical"))
    r = r.groupBy(F.lower("__k").alias("__k")).agg(F.min_by("type", "canonical").alias("type"), F.min("canonical").alias("canonical"))
    return names.join(r, F.lower("name") == F.col("__k"), "left").select("name", F.coalesce("type", F.lit("unknown")).alias("type"), "canonical")


def unknown_candidates(texts: DataFrame, registry: DataFrame, common: list[str]) -> DataFrame:
    """(id, name): capitalised tokens that the registry and the common words lack."""
    t = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{2,15}\b"), F.lit(0)))).alias("name"))
    known = registry.select(F.lower("name").alias("__k")).distinct()
    return t.where(~F.lower("name").isin(common)).join(known, F.lower("name") == F.col("__k"), "left_anti")
