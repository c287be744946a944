"""Queries of the name registry, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import entities, registry
from tessera.plans.fixtures import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


#: Names that the events speak of, by user.
NAMES = ["Alice", "Boris", "Carla Novak", "Dmitri", "Will", "Grace", "Hector", "Irene", "Juno"]
_NAME = "(" + repr(NAMES) + ")[user_id % 9 + 1]"
_TALK = f"""talk AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN concat('Hey ', n, ', are you there? ', n, ' said it works.', chr(10), n, ' wants more of it and she left.') WHEN 'view' THEN concat('We built ', n, '. ', n, ' v2 is out; pip install ', n, '.')
  WHEN 'error' THEN concat('Thanks ', n, '! ', n, ' told me.', chr(10), 'Will ', n, ' come? They decided.', chr(10), n, ': yes') WHEN 'purchase' THEN concat('the state of ', lower(n), ' in general') ELSE concat(n, ' is here, ', n, ' and ', n, '.') END AS text FROM (SELECT *, {_NAME} AS n FROM events) AS x)"""


def _talk(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    n = F.get(F.array(*map(F.lit, NAMES)), (F.col("user_id") % 9).cast("int"))
    e = e.withColumn("n", n)
    say = lambda *parts: F.concat(*(F.col("n") if p == "{}" else F.lit(p) for p in parts))
    text = (
        F.when(F.col("event_type") == "click", say("Hey ", "{}", ", are you there? ", "{}", " said it works.\n", "{}", " wants more of it and she left."))
        .when(F.col("event_type") == "view", say("We built ", "{}", ". ", "{}", " v2 is out; pip install ", "{}", "."))
        .when(F.col("event_type") == "error", say("Thanks ", "{}", "! ", "{}", " told me.\nWill ", "{}", " come? They decided.\n", "{}", ": yes"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("the state of "), F.lower("n"), F.lit(" in general")))
        .otherwise(say("{}", " is here, ", "{}", " and ", "{}", "."))
    )
    return e.select(F.col("event_id").alias("id"), text.alias("text"))


_SEED = f"""common AS (SELECT DISTINCT lower({_NAME}) AS word FROM events WHERE user_id % 9 IN (4, 5) UNION SELECT 'iran'), ppl AS (SELECT concat(upper(n_name[1]), lower(n_name[2:])) AS name, CASE WHEN n_regionkey = 1 THEN 'friend' END AS relationship, CASE WHEN n_regionkey = 2 THEN 'work' END AS context FROM nation WHERE n_regionkey < 3
  UNION ALL SELECT DISTINCT {_NAME}, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM events WHERE user_id % 9 IN (2, 5)), al AS (SELECT substring(name, 1, 5) AS alias, name FROM ppl WHERE length(name) > 6),
p2 AS (SELECT name, coalesce(relationship, '') AS relationship, coalesce(context, 'personal') AS contexts, (SELECT min(alias) FROM al WHERE al.name = ppl.name) AS alias FROM ppl),
people AS (SELECT name, 'person' AS type, coalesce(alias, '') AS aliases, relationship, contexts FROM p2 UNION ALL SELECT alias, 'person', name, relationship, contexts FROM p2 WHERE alias IS NOT NULL AND alias NOT IN (SELECT name FROM ppl)),
seeded AS (SELECT name, type, 'onboarding' AS source, aliases, relationship, contexts, 1.0e0 AS confidence, CAST(0 AS BIGINT) AS seen_count, lower(name) IN (SELECT word FROM common) AS ambiguous FROM people UNION ALL SELECT r_name, 'project', 'onboarding', '', '', '', 1.0e0, 0, false FROM region)"""


def _seeded(spark, sf_dir):
    e = view(spark, sf_dir, "events").withColumn("n", F.get(F.array(*map(F.lit, NAMES)), (F.col("user_id") % 9).cast("int")))
    none = F.lit(None).cast("string")
    nations = view(spark, sf_dir, "nation").where("n_regionkey < 3")
    people = nations.select(F.initcap(F.lower("n_name")).alias("name"), F.when(F.col("n_regionkey") == 1, "friend").alias("relationship"), F.when(F.col("n_regionkey") == 2, "work").alias("context"))
    people = people.withColumn("name", F.concat(F.substring("name", 1, 1), F.lower(F.substr("name", F.lit(2)))))
    people = people.unionByName(e.where("user_id % 9 IN (2, 5)").select(F.col("n").alias("name"), none.alias("relationship"), none.alias("context")).distinct())
    aliases = people.where("length(name) > 6").select(F.substring("name", 1, 5).alias("alias"), "name")
    common = e.where("user_id % 9 IN (4, 5)").select(F.lower("n").alias("word")).distinct().unionByName(spark.range(1).select(F.lit("iran").alias("word")))
    return registry.seed(people, view(spark, sf_dir, "region").select(F.col("r_name").alias("name")), aliases, common), common


def _flat(r):
    return r.select("name", "type", "source", F.array_join("aliases", ",").alias("aliases"), "relationship", F.array_join("contexts", ",").alias("contexts"), "confidence", "seen_count", "ambiguous")


@query(f"WITH {_SEED} SELECT * FROM seeded")
def entity_registry_seed(spark, sf_dir):
    return _flat(_seeded(spark, sf_dir)[0])


def _pattern(p: str) -> str:
    return "replace('(?im)" + p.replace("'", "''") + "', '{name}', name)"


def scores_sql(named: str) -> str:
    """Scores, type and confidence of a relation (id, name, frequency, text), as common table expressions that end in ``judged``."""
    count = lambda p: f"len(regexp_extract_all(text, {_pattern(p)}))"
    total = lambda ps: " + ".join(map(count, ps))
    pronouns = entities.PRONOUNS.replace("'", "''")
    return f"""sc AS (SELECT id, name, frequency, {total(entities.DIALOGUE)} AS dialogue, {total(entities.PERSON_VERBS)} AS verbs, {count(entities.DIRECT)} AS direct, ({total(entities.PROJECT_VERBS)}) * 2 + {count(entities.VERSIONED)} * 3 + {count(entities.CODE_REFERENCE)} * 3 AS project_score,
  len(list_filter(range(1, len(l) + 1), lambda j: contains(l[j], lower(name)) AND regexp_matches(array_to_string(l[greatest(j - 2, 1):j + 2], ' '), '{pronouns}'))) AS pronoun FROM (SELECT *, string_split(lower(text), chr(10)) AS l FROM {named}) AS z),
sd AS (SELECT *, dialogue * 3 + verbs * 2 + pronoun * 2 + direct * 4 AS person_score, CAST(dialogue > 0 AS INT) + CAST(verbs > 0 AS INT) + CAST(pronoun > 0 AS INT) + CAST(direct > 0 AS INT) AS kinds FROM sc),
sr AS (SELECT *, person_score / nullif(person_score + project_score, 0)::DOUBLE AS ratio FROM sd),
judged AS (SELECT *, CASE WHEN ratio IS NULL THEN 'uncertain' WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN 'person' WHEN ratio >= 0.7 THEN 'uncertain' WHEN ratio <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
  round(CASE WHEN ratio IS NULL THEN least(0.4e0, frequency / 50.0e0) WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN least(0.99e0, 0.5e0 + ratio * 0.5e0) WHEN ratio >= 0.7 THEN 0.4e0 WHEN ratio <= 0.3 THEN least(0.99e0, 0.5e0 + (1 - ratio) * 0.5e0) ELSE 0.5e0 END, 2) AS confidence FROM sr)"""


_CANDIDATES = "cand AS (SELECT id, name, count(*) AS frequency FROM (SELECT id, unnest(list_concat(regexp_extract_all(text, '\\b([A-Z][a-z]{1,19})\\b', 1), regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1))) AS name FROM talk) AS x GROUP BY id, name HAVING count(*) >= 3)"


@query(f"""WITH {_SEED}, {_TALK}, {_CANDIDATES}, named AS (SELECT c.id, c.name, c.frequency, t.text FROM cand AS c JOIN talk AS t ON t.id = c.id WHERE c.name NOT IN (SELECT name FROM seeded)), {scores_sql('named')}
SELECT * FROM seeded UNION ALL SELECT name, 'person', 'learned', '', '', 'personal', arg_min(confidence, id), CAST(arg_min(frequency, id) AS BIGINT), lower(name) IN (SELECT word FROM common) FROM judged WHERE type = 'person' AND confidence >= 0.75 GROUP BY name""")
def entity_registry_learn(spark, sf_dir):
    """Seeded, then learned from all texts, twice."""
    known, common = _seeded(spark, sf_dir)
    t = _talk(spark, sf_dir)
    return _flat(registry.learn(registry.learn(known, t, common), t, common))


_SIGNS = lambda ps: " + ".join("CAST(regexp_matches(lower(text), replace('" + p.replace("'", "''") + "', '{name}', lower(form))) AS INT)" for p in ps)


@query(f"""WITH {_SEED}, {_TALK}, forms AS (SELECT name, name AS form FROM seeded WHERE type = 'person' UNION SELECT name, aliases FROM seeded WHERE type = 'person' AND aliases <> ''),
hit AS (SELECT t.id, f.name, f.form, t.text FROM talk AS t, forms AS f WHERE regexp_matches(t.text, concat('(?i)\\b', f.form, '\\b')))
SELECT DISTINCT id, name FROM hit WHERE lower(form) NOT IN (SELECT lower(name) FROM seeded WHERE ambiguous) OR {_SIGNS(registry.PERSON_CONTEXT)} > {_SIGNS(registry.CONCEPT_CONTEXT)}""")
def entity_mentions(spark, sf_dir):
    return registry.mentions(_talk(spark, sf_dir), _seeded(spark, sf_dir)[0])
