import re

from tessera.llm.license_scan import BASE, op9_license_scan, scan, template_words


def brute(text):
    w = template_words(text or "")
    at = [(i, label) for label, phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    first, last = (min(i for i, _ in at), max(i for i, _ in at)) if at else (None, None)
    return len(w), len(at), first, last, ",".join(sorted({x for _, x in at}))


def same(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_base_phrases(spark):
    texts = {
        1: "Under the MIT License. under the mit license", 2: "under the mit-license", 3: "the apache license, version 2 cc by nc cc by nc",
        4: "cc by", 5: "underé the mit license", 6: "UNDER THE MİT LICENSE K cc_by_nc", 7: None, 8: "", 9: "cc by nc",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same(scan(df).collect(), texts)


def test_notices_by_voting(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software"
    df = spark.createDataFrame([(1, "x y z " + mit), (2, "permission is hereby denied to any person"), (3, "All rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in scan(df).collect()}
    assert got[1] == ("mit", "") and got[2] == ("", "") and got[3] == ("all-rights-reserved", "")


def test_odd_texts(odd, empty):
    rows = scan(odd).collect()
    assert len(rows) == odd.count() and scan(empty).count() == 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    same(rows, texts)


def test_driver_rows(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    same(rows, texts)
    plan = op9_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
