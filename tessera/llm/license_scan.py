"""License scan by diagonal voting, in DataFrame functions alone.

The rolling hashes of ``K`` words of a text are looked up among the templates' (which are fixed, and whose
number of words is checked), and those found meet the templates' places in one broadcast join.  A meeting votes for the
diagonal "word in the text minus word in the template".  Base phrases stand where a diagonal has all
votes of its phrase, that is, all words consecutively.  For longer notices, neighbouring diagonals
(shifted by a few inserted or dropped words) are merged, and a span is verified by its share of the
notice's votes.  Votes are counted in every task before they are shuffled.

Words: A-Z in lower case, then runs of anything but ASCII signs and blanks.  Null texts are empty:
no words and no labels.  One row per document; repeated rows of a document count once for its
votes and come out as often as they went in.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, documents

K = 3
SHIFT = 3
SHARE = 0.6
LARGEST = 20_000

#: Phrases of the base labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Notices of public licenses, for the labels that voting adds.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("all-rights-reserved", "all rights reserved"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def words_of(text: Column) -> Column:
    """Array of a text's words."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    plain = F.trim(F.regexp_replace(lower, _BETWEEN, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def templates(spark: SparkSession, base: list = BASE, notices: list = NOTICES, k: int = K) -> DataFrame:
    """(gram, template, place, words): every ``k`` words of every template."""
    rows = []
    for t, (_, text) in enumerate([*base, *notices]):
        w = template_words(text)
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(t, p, w[p : p + k]) for p in range(len(w) - k + 1)]
    if len(rows) > LARGEST:
        raise ValueError("too many template words to broadcast")
    quoted = ",".join("({},{},array({}))".format(t, p, ",".join("'" + x + "'" for x in w)) for t, p, w in rows)
    df = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(template, place, words)")
    return df.withColumn("gram", F.xxhash64(*(F.get("words", F.lit(j)) for j in range(k))))


def meetings(docs: DataFrame, base: list = BASE, notices: list = NOTICES, k: int = K) -> DataFrame:
    """(doc_id, text_hash, n_words, met) of every row; met: place and words of the k-grams whose hash a template has.

    The hashes of the templates are few and fixed, so the test is a look-up within the expression: only what meets a
    template leaves the text's row, and no row carries the text's words along.
    """
    hashes = [r[0] for r in templates(docs.sparkSession, base, notices, k).select("gram").distinct().collect()]  # LARGEST at most
    words = F.col("words")
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    near = F.filter(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))).isin(hashes))
    met = F.transform(near, lambda i: F.struct(i.alias("at"), F.slice(words, i + 1, k).alias("words")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    return rows.select("doc_id", "text_hash", F.size(words).cast("long").alias("n_words"), met.alias("met"))


def votes(met: DataFrame, base: list = BASE, notices: list = NOTICES, k: int = K) -> DataFrame:
    """(doc_id, text_hash, template, diagonal, votes) where anything met."""
    t = templates(met.sparkSession, base, notices, k).withColumnRenamed("words", "template_words")
    grams = met.select("doc_id", "text_hash", F.inline("met"))
    grams = grams.withColumn("gram", F.xxhash64(*(F.get("words", F.lit(j)) for j in range(k))))
    grams = grams.join(F.broadcast(t), "gram").where(F.col("words") == F.col("template_words"))
    return grams.groupBy("doc_id", "text_hash", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.size(F.collect_set("place")).alias("votes")
    )


def spans(found: DataFrame, base: list = BASE, notices: list = NOTICES, k: int = K, shift: int = SHIFT) -> DataFrame:
    """(doc_id, text_hash, template, first, last, votes, share, n_whole, first_whole, last_whole) after merging neighbouring diagonals.

    The last three tell of diagonals that alone have all votes: how many, the first and the last.
    """
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > shift, F.lit(True)).cast("int")
    merged = found.withColumn("new", new).withColumn("cluster", F.sum("new").over(by))
    full = F.get(F.array(*(F.lit(len(template_words(text)) - k + 1) for _, text in [*base, *notices])), F.col("template"))
    whole = F.when(F.col("votes") == full, F.col("diagonal"))
    each = merged.groupBy("doc_id", "text_hash", "template", "cluster").agg(
        F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes"),
        F.count(whole).alias("n_whole"), F.min(whole).alias("first_whole"), F.max(whole).alias("last_whole"),
    )
    return each.withColumn("share", F.least(F.lit(1.0), F.col("votes") / full))


def scan(docs: DataFrame, base: list = BASE, notices: list = NOTICES, k: int = K, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``."""
    label = F.get(F.array(*(F.lit(x) for x, _ in [*base, *notices])), F.col("template"))
    met = checkpointed(meetings(docs, base, notices, k))  # small rows: texts are read once
    found = spans(votes(met, base, notices, k), base, notices, k).withColumn("is_base", F.col("template") < len(base))
    found = found.where(F.when(F.col("is_base"), F.col("n_whole") > 0).otherwise(F.col("share") >= share))
    of_base = lambda c: F.when(F.col("is_base"), c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    each = found.groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(
        F.sum(of_base(F.col("n_whole"))).alias("n_base"), F.min(of_base(F.col("first_whole"))).alias("first_word"), F.max(of_base(F.col("last_whole"))).alias("last_word"),
        joined(of_base(label)).alias("base_labels"), joined(label).alias("labels"), F.max(F.when(F.col("is_base"), 1.0).otherwise(F.col("share"))).alias("score"),
    )
    rows = met.select("doc_id", F.col("text_hash").alias("__text"), "n_words")
    out = rows.join(each, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__hash")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
