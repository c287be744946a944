"""Spelling by a deletion index: two words within two edits share a form that both reach by dropping two letters or fewer.

The index is a table (form, word, freq), joined with the forms of the words asked for; the edit distance then decides.
Nothing is compared that shares no form, so the work grows with the words and not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import skip_spelling

#: Edits that are bridged, and letters of the longest word that is indexed or corrected.
EDITS, LONGEST = 2, 24
#: Fixed value: signs at a token's end that don't belong to the word.
TRAILING = ".,!?;:'\")"


def _without_one(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substr(c, i + 1)))


def forms(word: str | Column, edits: int = EDITS) -> Column:
    """The word and what is left of it after up to ``edits`` letters are dropped, distinct."""
    out = F.array(F.col(word) if isinstance(word, str) else word)
    for _ in range(edits):
        shorter = F.flatten(F.transform(F.filter(out, lambda x: F.length(x) > 0), _without_one))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def deletion_index(dictionary: DataFrame, edits: int = EDITS) -> DataFrame:
    """(form, word, freq) of a dictionary (word, freq); of a word that repeats the greatest frequency counts."""
    d = dictionary.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.max("freq").alias("freq"))
    return d.select(F.explode(forms("word", edits)).alias("form"), "word", "freq")


def suggestions(words: DataFrame, index: DataFrame, edits: int = EDITS) -> DataFrame:
    """(asked, word, freq, distance) for each word of ``words`` (asked) and every entry within ``edits`` of it.

    Pairs that meet in many forms are told once.
    """
    w = words.where((F.length("asked") > 0) & (F.length("asked") <= LONGEST)).select("asked").distinct()
    w = w.select("asked", F.explode(forms("asked", edits)).alias("form"))
    met = w.join(index, "form").select("asked", "word", "freq").distinct()
    return met.withColumn("distance", F.levenshtein("asked", "word")).where(F.col("distance") <= edits)


def corrections(words: DataFrame, dictionary: DataFrame, edits: int = EDITS) -> DataFrame:
    """(asked, corrected, distance): for each word that isn't in the dictionary its nearest entry, of these the most frequent, of these the least; words without one are left out."""
    index = deletion_index(dictionary, edits)
    unknown = words.select("asked").distinct().join(dictionary.select(F.col("word").alias("asked")).distinct(), "asked", "left_anti")
    best = F.struct("distance", (-F.col("freq")).alias("f"), F.col("word").alias("corrected"))
    found = suggestions(unknown, index, edits).groupBy("asked").agg(F.min(best).alias("b"))
    return found.select("asked", "b.corrected", "b.distance")


def correct_lines(texts: DataFrame, dictionary: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) with the words of quoted lines corrected; other lines, and all white space, stay as they are.

    A word is corrected if it begins in lower case, isn't a known name (name, in lower case), isn't skipped (skip_spelling) and
    isn't in the dictionary; the bound is two edits for up to seven letters and three beyond, of which the index bridges ``EDITS``.
    """
    body = F.regexp_extract(F.col("line"), r"(?s)^(\s*>.?)(.*)$", 2)
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.withColumn("quoted", F.startswith(F.ltrim("line"), F.lit(">")) & (F.trim(body) != ""))
    token = F.explode(F.regexp_extract_all(body, F.lit(r"\S+"), F.lit(0)))
    tokens = lines.where("quoted").select(token.alias("token")).distinct()
    bare = F.rtrim(F.col("token"), F.lit(TRAILING))
    tokens = tokens.withColumn("asked", bare).where((F.col("asked") != "") & ~skip_spelling("asked") & ~F.substring("asked", 1, 1).rlike(r"\p{Lu}"))
    tokens = tokens.join(names.select(F.lower("name").alias("__name")).distinct(), F.lower("asked") == F.col("__name"), "left_anti")
    lower = dictionary.select(F.lower("word").alias("__word")).distinct()
    tokens = tokens.join(lower, F.lower("asked") == F.col("__word"), "left_anti")
    fixed = tokens.join(corrections(tokens.select("asked"), dictionary).select("asked", "corrected"), "asked")
    fixed = fixed.select("token", F.concat("corrected", F.substr("token", F.length("asked") + 1)).alias("new"))
    # every token of every quoted line with its place, so that lines are put together again from pieces
    pieces = lines.where("quoted").select(id_col, "pos", F.posexplode(F.regexp_extract_all(body, F.lit(r"\S+|\s+"), F.lit(0))).alias("k", "token"))
    pieces = pieces.join(fixed, "token", "left").withColumn("token", F.coalesce("new", "token"))
    made = pieces.groupBy(id_col, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]), "").alias("body"))
    lines = lines.join(made, [id_col, "pos"], "left")
    head = F.regexp_extract(F.col("line"), r"(?s)^(\s*>.?)(.*)$", 1)
    lines = lines.withColumn("line", F.when(F.col("quoted"), F.concat(head, "body")).otherwise(F.col("line")))
    out = lines.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias(text_col))
    return out.unionByName(texts.where(F.col(text_col).isNull()).select(id_col, text_col))
