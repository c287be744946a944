"""Text queries on small tables of their own."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import entities
from tessera.plans import text_queries as Q


def test_keyword_overlap_takes_every_item(spark, tmp_path):
    items = spark.range(10_001, numPartitions=1).select((F.col("id") * 50).alias("item_id"), F.concat(F.lit("gato "), "id").alias("text"))
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "un Gato", "es")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.fn_keyword_overlap(spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("item_id"), F.sum("overlap")).first()
    assert tuple(rows) == (10_001, 10_001, 10_001.0)


def test_classification_takes_every_language(spark, tmp_path):
    text = "Zora said yes.\nZora asked them.\nHey Zora, Zora wrote it."
    docs = [(1, text, "en"), (2, text, "de"), (3, text + " Très bien.", "fr"), (4, text, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.entity_classification(spark, str(tmp_path)).where("name = 'Zora'").collect()
    assert sorted((r.doc_id, r.frequency, r.type) for r in rows) == [(d, 4, "person") for d in (1, 2, 3, 4)]


def test_candidates_against_brute_force(spark, tmp_path):
    docs = [(1, "Zora met Ana Lee. Zora saw Ana Lee; Zora left Ana Lee.", "en"), (2, "Hola Zora, The end. Zora y Zora, mañana.", "es"), (3, None, "en"), (4, "Zora. Zora.", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, text, _ in docs:
        names = re.findall(r"\b([A-Z][a-z]{1,19})\b", text or "") + re.findall(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", text or "")
        want |= {(d, x): n for x, n in Counter(names).items() if n >= 3 and x.lower() not in ("the", "and")}
    got = {(r.doc_id, r.name): r.frequency for r in Q.entity_candidates(spark, str(tmp_path)).collect()}
    assert got == want and (2, "Zora") in got


def _scores(name: str, text: str) -> tuple:
    count = lambda p: len(re.findall(p.replace("{name}", re.escape(name)), text, re.I | re.M | re.A))
    total = lambda ps: sum(map(count, ps))
    lines = text.lower().split("\n")
    pronoun = sum(name.lower() in x and bool(re.search(entities.PRONOUNS, " ".join(lines[max(i - 2, 0) : i + 3]), re.A)) for i, x in enumerate(lines))
    dialogue, verbs, direct = total(entities.DIALOGUE), total(entities.PERSON_VERBS), count(entities.DIRECT)
    project = total(entities.PROJECT_VERBS) * 2 + count(entities.VERSIONED) * 3 + count(entities.CODE_REFERENCE) * 3
    return dialogue * 3 + verbs * 2 + pronoun * 2 + direct * 4, project, sum(x > 0 for x in (dialogue, verbs, pronoun, direct))


def test_scores_against_brute_force_with_texts_searched_once(spark):
    say = ["hey {}", "Thanks {}", "HI {}", "> {}: yes", "{}: no", "[{}] and", '"{} said', "the {} Repo", "pip INSTALL {}", "{}.ts", "{}-core", "{}v2 x", "shipped {}", "{} loves it", "she left", "nothing", "Of theirs"]
    texts = [(i, "\n".join(say[(i * 7 + k * (i % 5 + 1)) % len(say)].format(("Zora", "zora", "Of", "Ana Lee")[(i + k) % 4]) for k in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (60, "\n".join(["she"] + ["Zora"] * 4 + ["it"]))], "doc_id int, text string")
    names = spark.createDataFrame([("Zora",), ("Of",), ("Ana Lee",)], "name string").withColumn("frequency", F.lit(3))
    plain = entities.scores(names.crossJoin(docs)).collect()
    shared = entities.scores(names.crossJoin(entities.prepared(docs))).collect()
    got = {(r.doc_id, r.name): (r.person_score, r.project_score, r.kinds) for r in shared}
    assert got == {(r.doc_id, r.name): _scores(r.name, r.text) for r in plain} == {(r.doc_id, r.name): (r.person_score, r.project_score, r.kinds) for r in plain}
    assert sum(p > 0 for p, _, _ in got.values()) > 20 and sum(q > 0 for _, q, _ in got.values()) > 20


def test_cues_are_of_every_alternative():
    assert entities._cues(entities.DIRECT) == ["hey", "thank", "hi"] and entities._cues(entities.VERSIONED) == [""]
    assert entities._cues(r"\bship(?:ping|ped)?\s+{name}\b") == ["ship"] and ".sh" in entities._cues(entities.CODE_REFERENCE)


def test_answers_of_any_letters(spark, tmp_path):
    items = [(1, "The  Cat, and a dog!"), (2, "El niño; the café"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.answer for r in Q.fn_normalize_answer(spark, str(tmp_path)).collect()}
    assert got == {1: "cat dog", 2: "el niño café", 3: None, 4: ""}
