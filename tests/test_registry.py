"""The registry by hand, and mentions against a search of every name in every text."""

import re

import pytest

from tessera.operators import registry as R

COMMON = ["will", "grace", "may"]


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([(w,) for w in COMMON], "word string")


@pytest.fixture(scope="module")
def seeded(spark, common):
    people = spark.createDataFrame([(" Maxwell ", "boss", "work"), ("Grace", None, None), ("Mary Ann O'Neil", "", None), ("Will", "", None), ("C. J. (Jay)", None, None), ("", "x", None), ("Grace", None, None)], "name string, relationship string, context string")
    projects = spark.createDataFrame([("Atlas",), ("Atlas",), (None,)], "name string")
    aliases = spark.createDataFrame([("Max", "Maxwell"), ("Gracie", "Grace"), ("Will", "Mary Ann O'Neil")], "alias string, name string")
    return R.seed(people, projects, aliases, common).cache()


def test_seed(seeded):
    got = {r.name: (r.type, r.source, r.aliases, r.contexts, r.ambiguous) for r in seeded.collect()}
    assert got == {
        "Maxwell": ("person", "onboarding", ["Max"], ["work"], False), "Max": ("person", "onboarding", ["Maxwell"], ["work"], False), "Grace": ("person", "onboarding", ["Gracie"], ["personal"], True),
        "Gracie": ("person", "onboarding", ["Grace"], ["personal"], False), "Mary Ann O'Neil": ("person", "onboarding", ["Will"], ["personal"], False), "Will": ("person", "onboarding", [], ["personal"], True),
        "C. J. (Jay)": ("person", "onboarding", [], ["personal"], False), "Atlas": ("project", "onboarding", [], [], False),
    }


def test_learning_twice_changes_nothing_more(spark, seeded, common):
    talk = "Hey May, thanks. May said it works and she left.\nMay wants more."
    texts = spark.createDataFrame([(2, talk + " May told me."), (1, talk), (3, "Hey Maxwell! Maxwell said so. Maxwell wants it, he does."), (4, "May may. May might."), (5, None)], "id long, text string")
    once = R.learn(seeded, texts, common)
    new = [r for r in once.collect() if r.source == "learned"]
    assert [(r.name, r.seen_count, r.ambiguous, r.contexts) for r in new] == [("May", 3, True, ["personal"])] and new[0].confidence >= 0.75
    assert sorted(map(str, R.learn(once, texts, common).collect())) == sorted(map(str, once.collect()))
    assert R.learned(seeded, texts).collect()[0].id == 1


def test_confirm(spark, seeded, common):
    found = spark.createDataFrame([("Riley", "person", None, "work"), ("Paris", "place", None, None), ("Will", "person", "kid", None)], "name string, type string, relationship string, context string")
    got = {r.name: r for r in R.confirm(seeded, found, common).collect()}
    assert (got["Riley"].confidence, got["Riley"].contexts, got["Riley"].source) == (0.9, ["work"], "wiki") and got["Paris"].type == "place"
    assert (got["Will"].relationship, got["Will"].ambiguous) == ("kid", True) and len(got) == seeded.count() + 2


def test_mentions_against_every_name(spark, seeded):
    texts = [
        "Max and MAXWELL met maxwells", "with Grace at noon", "the grace of it", "Grace", "mary ann  o'neil", "Mary Ann O'Neil, will you?", "I saw Will; will would do", "C. J. (Jay) x", "c.j. (jay)", "Atlas",
        "gracie said hi", None, "", "über-Max", "Maxé", "grace:\nhey grace", "would grace again", "will will will",
    ]
    rows = seeded.where("type = 'person'").collect()
    ambiguous = {r.name.lower() for r in rows if r.ambiguous}
    signs = lambda ps, n, t: sum(bool(re.search(p.replace("{name}", re.escape(n.lower())), t.lower())) for p in ps)
    want = set()
    for i, t in enumerate(texts):
        for r in rows:
            for f in [r.name, *r.aliases]:
                if re.search(rf"\b{re.escape(f)}\b", t or "", re.I) and (f.lower() not in ambiguous or signs(R.PERSON_CONTEXT, f, t) > signs(R.CONCEPT_CONTEXT, f, t)):
                    want.add((i, r.name))
    got = {(r.id, r.name) for r in R.mentions(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), seeded).collect()}
    assert got == want and (0, "Maxwell") in got and (2, "Grace") not in got


def test_mentions_of_long_names(spark):
    long = "Pablo Diego Jose Francisco de Paula Juan Nepomuceno"
    known = spark.createDataFrame([(long, "person", [], False), ("Pablo Diego", "person", ["P. D"], False), ("Pablo", "person", None, False)], "name string, type string, aliases array<string>, ambiguous boolean")
    texts = spark.createDataFrame([(0, f"so {long.upper()}, too"), (1, "Pablo Diego Jose"), (2, "Pablo"), (3, "Pablo  Diego"), (4, "p. d. Pablos"), (5, ""), (6, "diego pablo")], "id int, text string")
    got = sorted((r.id, r.name) for r in R.mentions(texts, known).collect())
    assert got == [(0, "Pablo"), (0, "Pablo Diego"), (0, long), (1, "Pablo"), (1, "Pablo Diego"), (2, "Pablo"), (3, "Pablo"), (4, "Pablo Diego"), (6, "Pablo")]


def test_what_learns_from_a_learned_registry_does_not_read_the_texts_again(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "name string, relationship string, context string")
    words = spark.createDataFrame([("will",)], "word string")
    seeded = R.seed(none, spark.createDataFrame([("Atlas",)], "name string"), spark.createDataFrame([], "alias string, name string"), words)
    texts = spark.range(3).select("id", F.lit("Hey Alice, Alice said yes.\nAlice: I think she is right. Thanks Alice, Alice told me.").alias("text"))
    once = R.learn(seeded, texts, words)
    assert sorted(r.name for r in once.collect()) == ["Alice", "Atlas"]
    leaves = once._jdf.queryExecution().withCachedData().collectLeaves()
    assert "Range" not in {leaves.apply(k).nodeName() for k in range(leaves.size())}


def test_words_of_texts_do_not_gather_in_the_driver(spark, seeded, tmp_path):
    """A few kB of events in a file may be many words: no side of the joins with texts is broadcast, whatever the file's size says."""
    from pyspark.sql import functions as F

    spark.range(2000).select("id", F.lit("Hey Max, " + "are you there? " * 50).alias("text")).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    plan = R.mentions(texts, seeded)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join [id#" in x or "Join [__k#" in x]
    assert len(joins) == 2 and all("SortMergeJoin" in x for x in joins)
    assert R.mentions(texts, seeded).groupBy("name").count().collect()[0][1] == 2000
