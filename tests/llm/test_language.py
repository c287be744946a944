import zlib
from collections import Counter

from tessera.llm.language_id import PROFILE, UNKNOWN, Ranks, fit, identify, ngram_counts, ngrams, op7_language_id


def test_ngrams_by_hand():
    codes, counts = ngrams("ab, a")
    name = lambda c: "".join(chr(x) if x else "_" for x in ((c >> 42) & 0x1FFFFF, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF)).lstrip("_")
    got = dict(zip(map(name, codes.tolist()), counts.tolist()))
    assert got["a"] == 4 or sum(counts) == 3 + 5 + 3
    assert counts.sum() == 3 + 5 + 3  # letters; pairs of _ab_a_; triples that don't cross a word


def test_distance_by_hand():
    m = Ranks({"x": [97, 98], "y": [98, 97]}, 2)
    codes, counts = ngrams("aab")
    own = codes[(-counts).argsort(kind="stable")][:2].tolist()
    for lang, profile in (("x", [97, 98]), ("y", [98, 97])):
        d = sum(abs(profile.index(c) - r) if c in profile else 2 for r, c in enumerate(own))
        if m.predict("aab")[0] == lang:
            assert abs(m.predict("aab")[1] - (1 - d / 4)) < 1e-12


def test_odd_texts(odd, empty):
    rows = identify(odd).collect()
    assert len(rows) == odd.count() and identify(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    for i in (0, 1, 2, 11):
        assert by[i].lang_pred == UNKNOWN and by[i].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_nothing_to_learn_from(odd):
    assert {r.lang_pred for r in identify(odd.where("lang IS NULL")).collect()} == {UNKNOWN}


def test_counts_add_up(odd):
    a = ngram_counts(odd.repartition(5)).agg({"n": "sum"}).first()[0]
    b = sum(int(ngrams(r.text)[1].sum()) for r in odd.where("lang IS NOT NULL AND text IS NOT NULL").collect())
    assert a == b
    assert set(fit(odd)) == {"en", "fr"}


def test_held_out_accuracy(spark, sf):
    pred = op7_language_id(spark, sf).where("held_out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    both = pred.join(docs, "doc_id").selectExpr("avg(cast(lang = lang_pred as double))").first()[0]
    assert both > 0.95


def plain_ngrams(text):
    """Counts of letters, pairs and triples of a text, letter by letter; a word's end is 0."""
    marked = [0]
    for c in text.lower():
        if c.isalpha():
            marked.append(ord(c))
        elif marked[-1]:
            marked.append(0)
    if marked[-1]:
        marked.append(0)
    out = Counter(c for c in marked if c)
    out.update((a << 21) | b for a, b in zip(marked, marked[1:]))
    out.update((a << 42) | (b << 21) | c for a, b, c in zip(marked, marked[1:], marked[2:]) if b)
    return out


def first(counts):
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]


def brute(rows):
    """(held_out, lang_pred, score) of every row by the definition."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows]
    sums = {}
    for (d, text, lang), h in zip(rows, held):
        if d is not None and not h and text is not None and lang is not None:
            sums.setdefault(lang, Counter()).update(plain_ngrams(text))
    place = {lang: {c: k for k, c in enumerate(first(n))} for lang, n in sorted(sums.items())}
    out = []
    for (_, text, _), h in zip(rows, held):
        own = first(plain_ngrams(text or "")) if any(c.isalpha() for c in (text or "").lower()) else []
        away = {lang: sum(abs(p[c] - k) if c in p else PROFILE for k, c in enumerate(own)) for lang, p in place.items()}
        best = min(away, key=away.get) if own and away else None
        out.append((h, best or UNKNOWN, 1 - away[best] / (PROFILE * len(own)) if best else 0.0))
    return out


def test_query_against_brute_force(spark, sf, odd):
    for docs, found in ((spark.read.parquet(f"{sf}/documents.parquet"), op7_language_id(spark, sf)), (odd, identify(odd))):
        rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
        want = sorted(((d is None, d or 0, *x[:2], round(x[2], 9)) for (d, _, _), x in zip(rows, brute(rows))))
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.lang_pred, round(r.score, 9)) for r in found.collect()) == want
