"""A registry of names that learns: seeded people and projects, names learned from texts, and who a text speaks of.

A registry is a table (``REGISTRY``).  Every function returns the registry after its change, or rows about texts; learning
from the same texts again changes nothing, as known names aren't candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.entities import candidates, classify, scores
from tessera.operators.merges import _cut

REGISTRY = "name string, type string, source string, aliases array<string>, relationship string, contexts array<string>, confidence double, seen_count long, ambiguous boolean"
_COLUMNS = [c.split()[0] for c in REGISTRY.split(", ")]
#: Patterns with {name} in place of a name that is a common word too, where it is a person and where it isn't.
PERSON_CONTEXT = [
    r"\b{name}\s+said\b", r"\b{name}\s+told\b", r"\b{name}\s+asked\b", r"\b{name}\s+laughed\b", r"\b{name}\s+smiled\b", r"\b{name}\s+was\b", r"\b{name}\s+is\b",
    r"\b{name}\s+called\b", r"\b{name}\s+texted\b", r"\bwith\s+{name}\b", r"\bsaw\s+{name}\b", r"\bcalled\s+{name}\b", r"\btook\s+{name}\b", r"\bpicked\s+up\s+{name}\b",
    r"\bdrop(?:ped)?\s+(?:off\s+)?{name}\b", r"\b{name}(?:'s|s')\b", r"\bhey\s+{name}\b", r"\bthanks?\s+{name}\b", r"^{name}[:\s]",
    r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{name}\b",
]
CONCEPT_CONTEXT = [
    r"\bhave\s+you\s+{name}\b", r"\bif\s+you\s+{name}\b", r"\b{name}\s+since\b", r"\b{name}\s+again\b", r"\bnot\s+{name}\b", r"\b{name}\s+more\b", r"\bwould\s+{name}\b",
    r"\bcould\s+{name}\b", r"\bwill\s+{name}\b", r"(?:the\s+)?{name}\s+(?:of|in|at|for|to)\b",
]
#: Fixed value: confidence from which a learned person is taken in.
LEAST = 0.75


def _ambiguous(rows: DataFrame, common: DataFrame) -> DataFrame:
    """``rows`` with whether the name is among the common words (word)."""
    c = common.select(F.lower("word").alias("__w")).distinct()
    return rows.join(c, F.lower("name") == F.col("__w"), "left").withColumn("ambiguous", F.col("__w").isNotNull() & (F.col("type") == "person")).drop("__w")


def seed(people: DataFrame, projects: DataFrame, aliases: DataFrame, common: DataFrame) -> DataFrame:
    """A registry of people (name, relationship, context), projects (name) and short forms (alias, name).

    A short form is an entry of its own, with the full name as its alias.  Of a person or a short form told twice the least row counts.
    """
    none = F.array().cast("array<string>")
    p = people.select(F.trim("name").alias("name"), "relationship", F.coalesce("context", F.lit("personal")).alias("context")).where("name <> ''")
    p = p.groupBy("name").agg(F.min(F.struct(F.coalesce("relationship", F.lit("")).alias("relationship"), "context")).alias("p"))
    a = aliases.groupBy("name").agg(F.min("alias").alias("alias"))
    p = p.join(a, "name", "left").select("name", "p.relationship", "p.context", "alias")
    short = p.where("alias IS NOT NULL").join(p.select(F.col("name").alias("alias")), "alias", "left_anti")
    both = p.select("name", F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(none).alias("aliases"), "relationship", "context").unionByName(
        short.select(F.col("alias").alias("name"), F.array("name").alias("aliases"), "relationship", "context")
    )
    both = both.select("name", F.lit("person").alias("type"), F.lit("onboarding").alias("source"), "aliases", "relationship", F.array("context").alias("contexts"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("seen_count"))
    names = projects.select("name").where("name IS NOT NULL").distinct()
    names = names.select("name", F.lit("project").alias("type"), F.lit("onboarding").alias("source"), none.alias("aliases"), F.lit("").alias("relationship"), none.alias("contexts"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("seen_count"))
    return _ambiguous(both.unionByName(names), common).select(*_COLUMNS)


def learned(registry: DataFrame, texts: DataFrame, least: float = LEAST, stop: list[str] = (), often: int = 3) -> DataFrame:
    """(name, confidence, seen_count, id): people that texts (id, text) speak of and the registry lacks, from the first text that is sure of them.

    Texts are taken in order of id, as if one after the other: a name is learned once.
    """
    c = candidates(texts.select("id", "text"), list(stop), often, ["id"])
    c = c.join(registry.select("name").distinct(), "name", "left_anti").join(texts.select("id", "text"), "id")
    sure = classify(scores(c)).where((F.col("type") == "person") & (F.col("confidence") >= least))
    first = F.min_by(F.struct("confidence", "frequency"), "id")
    return sure.groupBy("name").agg(first.alias("f"), F.min("id").alias("id")).select("name", "f.confidence", F.col("f.frequency").alias("seen_count"), "id")


def learn(registry: DataFrame, texts: DataFrame, common: DataFrame, context: str = "personal", **how) -> DataFrame:
    """The registry with what ``learned`` finds."""
    none = F.array().cast("array<string>")
    new = learned(registry, texts, **how).select(
        "name", F.lit("person").alias("type"), F.lit("learned").alias("source"), none.alias("aliases"), F.lit("").alias("relationship"), F.array(F.lit(context)).alias("contexts"), "confidence", "seen_count",
    )
    new = _cut(_ambiguous(new, common).select(*_COLUMNS))  # names, few beside the texts: what learns from this registry needn't read those again
    return registry.select(*_COLUMNS).unionByName(new)


def confirm(registry: DataFrame, found: DataFrame, common: DataFrame) -> DataFrame:
    """The registry with researched words (name, type, relationship, context) that were confirmed; they take the place of entries of that name."""
    none = F.array().cast("array<string>")
    new = found.groupBy("name").agg(F.min(F.struct("type", F.coalesce("relationship", F.lit("")).alias("relationship"), F.coalesce("context", F.lit("personal")).alias("context"))).alias("f"))
    new = new.select("name", "f.type", F.lit("wiki").alias("source"), none.alias("aliases"), "f.relationship", F.array("f.context").alias("contexts"), F.lit(0.9).alias("confidence"), F.lit(0).cast("long").alias("seen_count"))
    kept = registry.select(*_COLUMNS).join(new.select("name"), "name", "left_anti").select(*_COLUMNS)
    return kept.unionByName(_ambiguous(new, common).select(*_COLUMNS))


def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _escaped(name: str) -> Column:
    return F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def _signs(patterns: list[str]) -> Column:
    """How many of the patterns the lower-case text has for the lower-case name ``__e``."""
    return sum((F.regexp_like(F.lower("text"), F.replace(F.lit(p), F.lit("{name}"), F.col("__e"))).cast("int") for p in patterns), F.lit(0))


def mentions(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, name): the people whose names or aliases stand in texts (id, text) as words, in any case.

    Words and pairs of words are joined with the first two words of the names, and the text is then searched for the name as
    it is written.  A name that is a common word too counts only where more speaks for a person than against.  Both joins
    shuffle: a table of texts may look small in its file, and its words must not gather in the driver.
    """
    people = registry.where("type = 'person'").select("name", "ambiguous", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form"))
    people = people.withColumn("__k", F.array_join(F.slice(_words("form"), 1, 2), " ")).where("__k <> ''")
    flagged = people.where("ambiguous").select(F.lower("name").alias("__low")).distinct()  # a form is ambiguous if it is the name of an ambiguous entry
    people = people.join(flagged, F.lower("form") == F.col("__low"), "left").withColumn("doubtful", F.col("__low").isNotNull()).drop("__low", "ambiguous")
    w = texts.select("id", _words("text").alias("w"))
    pairs = F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    runs = w.select("id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("__k"))
    met = runs.hint("merge").join(people, "__k").select("id", "name", "form", "doubtful").distinct().hint("merge").join(texts.select("id", "text"), "id")
    met = met.withColumn("__e", _escaped("form")).where(F.regexp_like("text", F.concat(F.lit(r"(?iU)\b"), F.col("__e"), F.lit(r"\b"))))
    met = met.withColumn("__e", F.lower("__e"))
    sure = ~F.col("doubtful") | (_signs(PERSON_CONTEXT) > _signs(CONCEPT_CONTEXT))
    return met.where(sure).select("id", "name").distinct()
