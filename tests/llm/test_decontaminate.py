import random

import numpy as np

from tessera.llm import decontaminate as D
from tessera.llm import shingles


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        assert D.lcs(a, b) == table_lcs(a, b)


def world(rng, items=30, docs=120):
    vocabulary = [f"w{int(300 * rng.random() ** 2)}" for _ in range(2000)]
    rare = lambda: f"r{rng.randrange(4000)}"
    word = lambda: rare() if rng.random() < 0.5 else rng.choice(vocabulary)
    bench = [(i, " ".join(word() for _ in range(rng.randint(15, 90)))) for i in range(items)]
    rows, planted = [], set()
    for d in range(docs):
        w = [word() for _ in range(rng.choice([5, 80, 400]))]
        if d % 3 == 0:
            item = rng.randrange(items)
            p = bench[item][1].split()
            if d % 2:  # a paraphrase: one word in six is another one
                p = [word() if rng.random() < 1 / 6 else x for x in p]
            at = rng.randint(0, len(w))
            w[at:at] = p
            planted.add((d, item))
        rows.append((d, " ".join(w).capitalize()))
    return bench, rows, planted


def test_planted_passages_and_no_others(spark):
    bench, rows, planted = world(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, b).collect()}
    assert got == planted
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, b, block=9).collect()} == planted  # several blocks
    assert D.clean(docs, b).count() == len(rows) - len({d for d, _ in planted})


def test_svd_is_near_the_exact_one(spark):
    bench, _, _ = world(random.Random(4), 60)
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = D.passages(b).repartition(3)
    items = rows.collect()
    vocabulary = sorted({w for r in items for w in r["words"]})
    known = {w: i for i, w in enumerate(vocabulary)}
    idf = np.ones(len(vocabulary))
    v = D.randomised_svd(rows, known, idf, rank=10)
    a = np.zeros((len(items), len(vocabulary)))
    for k, r in enumerate(items):
        ids, x = D.tf_idf(r["words"], known, idf)
        a[k, ids] = x / np.linalg.norm(x)
    best = np.linalg.svd(a)[1][:10]
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-8)
    assert np.linalg.norm(a @ v) >= 0.97 * np.linalg.norm(best)


def test_long_texts_are_searched_in_segments(spark, monkeypatch):
    bench, _, _ = world(random.Random(6), 5)
    rng = random.Random(7)
    w = [f"z{rng.randrange(10**6)}" for _ in range(40_000)]
    w[33_000:33_000] = bench[3][1].split()
    docs = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, "")], "doc_id long, text string")
    got = D.leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 3)] and abs(got[0].first_word - 33_000) < 64


def test_odd_tables(spark, odd, empty):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog"), (None, "x y")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(odd, b).collect()] == [(15, 3)]
    assert D.leaks(empty, b).count() == 0 and D.leaks(odd, b.where("false")).count() == 0
    assert D.clean(odd, b).columns == odd.columns


def test_word_numbers(monkeypatch):
    monkeypatch.setattr(shingles, "HASHED", 64)
    shingles._made.clear()
    texts = ["a b", None, "", "Été, ñ_1 漢字 ²x “quoted”—dash", "x" * 200 + " y", "b\na İ Σ", "  "]
    hashes, begin = D.word_hashes(texts)
    words = [D.words_of(t) for t in texts]
    assert np.diff(begin).tolist() == list(map(len, words))
    flat = [w for part in words for w in part]
    assert len(set(hashes.tolist())) == len(set(flat)) and dict(zip(flat, hashes.tolist())) == {w: h for w, h in zip(flat, hashes.tolist())}
    known = D.Vocabulary(sorted(set(flat) - {"b", "y"}))
    assert [known.words[n] if n < known.size else None for n in known.numbers(hashes)] == [w if w not in ("b", "y") else None for w in flat]
    shingles._made.clear()


def test_rows_without_an_id_are_searched(spark):
    bench, _, _ = world(random.Random(3), 4)
    rows = [(None, "see " + bench[1][1]), (None, "nothing to see here at all"), (5, bench[2][1]), (5, "another text under the same number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, b).collect()} == {(None, 1), (5, 2)}
    assert sorted(map(str, D.clean(docs, b).collect())) == sorted(map(str, docs.where("text LIKE 'nothing%' OR text LIKE 'another%'").collect()))


def test_retrieval_against_brute_force():
    """Every window of every size, with sums and cosines taken word by word."""
    rng = random.Random(9)
    bench, rows, _ = world(rng, 12, 40)
    items = [(i, k, w) for i, t in bench for k, w in enumerate(D.cut(D.words_of(t)))]
    vocabulary = D.Vocabulary(sorted({w for _, _, words in items for w in words}))
    idf = np.linspace(0.5, 4, vocabulary.size)
    space = np.linalg.qr(np.random.default_rng(1).standard_normal((vocabulary.size, 20)))[0]
    found = D.Retrieval(items, vocabulary, idf, space)
    vector = lambda words: sum((idf[n] * space[n] for n in (vocabulary.number.get(w) for w in words) if n is not None), np.zeros(20))
    mass = lambda words: sum(idf[n] ** 2 for n in (vocabulary.number.get(w) for w in words) if n is not None)
    for _, text in rows:
        words = D.words_of(text)
        want = {}
        for item, _, passage in items:
            w = int(D.window_sizes(np.array([len(passage)]))[0])
            for a in range(0, max(1, len(words) - w // 2), w // 4):
                part = words[a : a + w]
                v, p = vector(part), vector(passage)
                if mass(part) < D.MASS * mass(passage) or v @ p < D.COSINE * np.linalg.norm(v) * np.linalg.norm(p) or not np.linalg.norm(v):
                    continue
                reach = max(4, len(passage) // 3)
                near = words[max(0, a - reach) : min(a + w, len(words)) + reach]
                share = table_lcs(passage, near) / len(passage)
                rare = sorted(set(passage), key=lambda x: (-idf[vocabulary.number[x]], x))[: D.ANSWER_WORDS]
                answer = sum(x in near for x in rare) / len(rare)
                if share >= D.LCS or (share >= D.LCS_LOOSE and answer >= D.ANSWER):
                    want[item] = max(want.get(item, (0, 0)), (share, answer))
        hashes, _ = D.word_hashes([text])
        got = {item: (share, answer) for item, _, share, answer, _ in found.search(text, vocabulary.numbers(hashes))}
        assert got == want


def test_recall_of_paraphrases_among_thousands_of_passages():
    """Passages of lengths between the windows' sizes, copied or with three words in ten replaced, within other text."""
    rng = random.Random(11)
    common = [f"w{i}" for i in range(400)]
    word = lambda: f"r{rng.randrange(6000)}" if rng.random() < 0.5 else rng.choice(common)
    items = [(i, 0, [word() for _ in range(rng.choice([9, 17, 19, 33, 36, 45, 60]))]) for i in range(1500)]
    vocabulary = D.Vocabulary(sorted({w for _, _, words in items for w in words}))
    idf = np.array([1.0 if w[0] == "w" else 4.0 for w in vocabulary.words])
    rows = np.zeros((len(items), vocabulary.size), np.float32)
    for i, _, words in items:
        for w in words:
            rows[i, vocabulary.number[w]] += idf[vocabulary.number[w]]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    q = np.linalg.qr(rows.T @ (rows @ np.random.default_rng(0).standard_normal((vocabulary.size, 80)).astype(np.float32)))[0]
    found = D.Retrieval(items, vocabulary, idf, q[:, :64].astype(float))
    hits = {0.0: 0, 0.3: 0}
    for share in hits:
        for i, _, words in rng.sample(items, 150):
            text = [word() for _ in range(60)] + [word() if rng.random() < share else w for w in words] + [word() for _ in range(60)]
            text = " ".join(text)
            hits[share] += any(m[0] == i for m in found.search(text, vocabulary.numbers(D.word_hashes([text])[0])))
    assert hits[0.0] >= 147 and hits[0.3] >= 110
