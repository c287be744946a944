import random
import re
import time

import numpy as np
import pytest

from tessera.llm import line_dedup as L


def norm(line):
    t = re.sub(rb"[^a-z0-9_\x80-\xff]+", b" ", line.lower().encode())
    return re.sub(rb"\d+", b"0", t).strip(b" ")


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def brute(docs):
    """Lost lines by edit similarity alone, over all pairs."""
    lines = [(d, i, norm(x).decode("latin-1")) for d, t in docs for i, x in enumerate((t or "").split("\n")) if norm(x)]
    own = sorted({x for _, _, x in lines}, key=len)
    up = {x: x for x in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(own):
        for y in reversed(own[:i]):
            if len(y) * 100 < L.SIMILAR * len(x):
                break
            if L.similar(x, y):
                up[root(x)] = root(y)
    seen, gone = set(), {}
    for d, i, x in sorted(lines):
        if root(x) in seen:
            gone.setdefault(d, []).append(i)
        seen.add(root(x))
    return gone


def test_normalised_and_ranges():
    texts = ["A  b,\n\n c-d 12 3", None, "", "Été!\n...", " x \n y"]
    data, a, b = L.normalised(texts)
    want = [norm(x) for t in texts for x in (t or "").split("\n")]
    assert [data[i:j] for i, j in zip(a, b)] == want


def test_distance_and_bounds():
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.choice(["ab", "the", "x", "thing", "of"]) for _ in range(rng.randint(1, 20))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice(["q", "the"])] * rng.randint(0, 1)
        a, b = " ".join(a), " ".join(b)
        d = levenshtein(a, b)
        assert L.edit_distance(a, b) == d and L.at_least(a, b) <= d <= L.at_most(a, b, 10**9)
        assert L.similar(a, b) == (d * 100 <= 10 * max(len(a), len(b)))


def signed(lines):
    data = "\n".join(lines).encode("latin-1")
    end = np.cumsum([len(x) + 1 for x in lines]) - 1
    words = L.line_words(data, np.append(0, end[:-1] + 1))
    simhash, blocks, each = L.signatures(*words)
    at = np.append(0, np.cumsum(each))
    return simhash, [set(blocks[a:b].tolist()) for a, b in zip(at, at[1:])], words[-1]


def changed(rng, line, kind, words):
    w = line.split(" ")
    if kind == "character":
        i = rng.randrange(len(line))
        return line[:i] + rng.choice("abcdefghij") + line[i + (line[i] != " ") :]
    if kind == "word dropped":
        k = rng.randrange(len(w))
        return " ".join(w[:k] + w[k + 1 :])
    for _ in range(kind):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


@pytest.mark.parametrize("kind", ["character", "word dropped", 1, 2, 3])
def test_recall_against_edit_similarity(sf, kind):
    """Of pairs of at least 90 % edit similarity, nine in ten meet; in each band of lengths with enough pairs too."""
    import duckdb

    rng = random.Random(4)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    data, a, b = L.normalised(texts)
    lines = sorted({data[i:j].decode("latin-1") for i, j in zip(a, b) if j > i})
    words = [w for x in lines for w in x.split(" ")]
    pairs = [(x, changed(rng, x, kind, words)) for x in lines]
    pairs = [(x, y) for x, y in pairs if x != y and y.strip() and "  " not in y and L.similar(x, y)]
    (g, s, n), (h, t, _) = signed([x for x, _ in pairs]), signed([y for _, y in pairs])
    size = np.array([[len(x), len(y)] for x, y in pairs])
    met = np.array([bool(x & y) for x, y in zip(s, t)]) & ~L.ruled_out(g, h, size[:, 0], size[:, 1])
    assert len(pairs) > 300 and met.mean() >= 0.95
    for low, high in ((0, 12), (12, 20), (20, 40), (40, 100), (100, 10**6)):
        band = met[(n >= low) & (n < high)]
        assert len(band) < 60 or band.mean() >= 0.9, (low, high, len(band))


def test_large_groups_take_bounded_time():
    """Near copies of a line, each with a word of its own."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    lines = [" ".join([*base[:30], f"x{i}", *base[31:]]) for i in range(20_000)]
    began = time.process_time()
    simhash, blocks, n = signed(lines)
    assert all(blocks[0] & b for b in blocks)
    links = L.verified(list(range(len(lines))), [{"line": x, "simhash": int(v)} for x, v in zip(lines, simhash.view(np.int64))])
    assert len(links) == len(lines) - 1 and time.process_time() - began < 30


def crowd(rng, n, passage, words=48):
    """Lines of one common passage of so many words, each with a near copy of 4 words replaced."""
    vocabulary = [f"{a}{b}{c}{d}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst" for d in ("", "e", "ing", "ed")]
    common = [rng.choice(vocabulary) for _ in range(passage)]
    out = []
    for _ in range(n):
        w = common + [rng.choice(vocabulary) for _ in range(words - passage)]
        v = list(w)
        for _ in range(4):
            v[rng.randrange(words)] = rng.choice(vocabulary)
        out.append((" ".join(w), " ".join(v)))
    return out


@pytest.mark.parametrize("others", [0, 300, 1500])
def test_recall_in_a_crowded_bucket(others):
    """End to end, blocks, SimHashes and trigrams included: similar lines link, however many others hold the same passage."""
    rng = random.Random(11)
    both = crowd(rng, 100 + others, 24)
    pairs, rest = both[:100], [x for x, _ in both[100:]]
    lines = list(dict.fromkeys([x for p in pairs for x in p] + rest))
    simhash, _, _ = signed(lines)
    forest = L.verified(list(range(len(lines))), [{"line": x, "simhash": int(v)} for x, v in zip(lines, simhash.view(np.int64))])
    group = {x: i for i, x in enumerate(lines)}
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in forest:
        assert L.similar(lines[a], lines[b])
        up[root(a)] = root(b)
    similar = [(a, b) for a, b in pairs if a != b and L.similar(a, b)]
    found = sum(root(group[a]) == root(group[b]) for a, b in similar)
    assert len(similar) >= 90 and found >= 0.9 * len(similar)


def test_trigrams_rule_out_no_similar_line():
    rng = random.Random(6)
    for length in (1, 2, 3, 40, 300, 3000):
        words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
        lines = [" ".join(rng.choice(words) for _ in range(length)) for _ in range(3)]
        for x in list(lines):
            for _ in range(6):
                y = list(x)
                for _ in range(rng.randint(0, len(x) // 10)):
                    k = rng.randrange(len(y) + 1)
                    y[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
                if y:
                    lines.append("".join(y))
        bits, size = L.trigram_bits(lines), np.array([len(x) for x in lines])
        assert bits.shape[0] == len(lines)
        a, b = np.triu_indices(len(lines), 1)
        far = L.too_far(bits[a], bits[b], size[a], size[b])
        for i, j in zip(a[far].tolist(), b[far].tolist()):
            assert L.edit_distance(lines[i], lines[j]) * 10 > max(size[i], size[j])
        assert length != 40 or far.any()


def test_tell_forgets_nothing_before_its_bound(monkeypatch):
    rng = np.random.default_rng(1)
    told, seen = [], set()
    for _ in range(60):
        keys = np.unique(rng.integers(0, 3000, 200))
        fresh = np.ones(len(keys), bool)
        L.tell(told, keys, fresh)
        assert set(keys[fresh].tolist()) == set(keys.tolist()) - seen
        seen |= set(keys.tolist())
    assert sum(map(len, told)) == len(seen) and len(told) < 12
    monkeypatch.setattr(L, "TOLD", 10)
    L.tell(told, np.array([-5]), np.ones(1, bool))
    assert sum(map(len, told)) == 1


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30, 80]))) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split() if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(12)]
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] += rng.choice(["x", "7", "s"])
            lines.append(" ".join(w).capitalize() + rng.choice(["", ".", "  "]))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    out = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    for d, t in docs:
        kept = [x for i, x in enumerate(t.split("\n")) if i not in want.get(d, [])]
        assert out[d].text == "\n".join(kept) and (out[d].n_lines, out[d].n_kept) == (len(t.split("\n")), len(kept))


def test_odd_texts(odd, empty):
    out = L.dedup_lines(odd)
    assert out.count() == odd.count() and L.dedup_lines(empty).count() == 0
    assert out.columns == [*odd.columns, "n_lines", "n_kept"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[0].n_lines == 0 and rows[1].text == ""
    assert rows[5].n_kept == 1 and rows[7].n_kept == 0  # row 7 repeats row 6


def test_simhash_is_the_majority():
    parts = ["one two three four", "one", "two", "three", "four", "two three four", "one three four", "one two four", "one two three"]
    (whole, _, _), blocks = signed(parts), signed(parts[:1])[1]
    bits = np.array([[int(x) >> k & 1 for k in range(64)] for x in whole[1:5]]).sum(axis=0)
    assert int(whole[0]) == sum(1 << k for k in range(64) if bits[k] >= 3)
    sums = [L.line_words(x.encode(), np.zeros(1, int))[0].sum() for x in parts]
    assert blocks[0] == {int(whole[k] + sums[k]) for k in (0, 5, 6, 7, 8)}  # the whole, and without each word
    assert not signed(["a b c d"])[1][0]  # too short for a similar line


def test_long_lines_and_equal_words():
    lines = ["a " * 1000 + "b", "same " * 70_000 + "end", "x" * 300_000, "p q r s t u v w x y z a b c"]
    simhash, blocks, n = signed([x.strip() for x in lines])
    assert n.tolist() == [1001, 70_001, 1, 14] and all(blocks)


def test_similar_is_exact_beyond_alignments():
    a = "f b eee ff ee ff fff aaa b fff ff bb ee hh g a aaa hhh e ff ff ee fff c cc ddd c cc a eee b e b ddd ccc g ff e ddd h gg fff dd bb g aaa ggg h ggg g ff a eee aaa bb fff eee ggg ggg ee"
    b = "f b eee ff ee ff fff aaaa b fff ffbb ee hh g a aaa hhh e ff ff eefff c cca ddd c cc a eee b e b ddeccc g ff ea ddd h gg fff dd bb g aaa ggg h ggg g ff c eee aaa bb fff eee ggg ggg ee"
    assert levenshtein(a, b) == 8 and L.at_most(a, b, 99) > 1.25 * 18.2 and L.similar(a, b)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=39)) for _ in range(150)]
    long = " ".join(words)
    changed = " ".join(w[:20] + "z" + w[21:] for w in words)  # no word is left as it was
    assert len(long) > 4096 and L.similar(long, changed)
    assert not L.similar(long, " ".join(w[:15] + "zzzzz" + w[20:] for w in words))


def test_distance_within_a_limit():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(1, 120)))
        b = list(a) if rng.random() < 0.7 else rng.choices("abc", k=rng.randint(1, 120))
        for _ in range(rng.randint(0, 40)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        b, limit = "".join(b), rng.choice([3, 10.5, 17, 30])
        d = levenshtein(a, b)
        assert (L.edit_distance(a, b, limit) <= limit) == (d <= limit) and (d > limit or L.edit_distance(a, b, limit) == d)


def test_distances_of_many_pairs_are_those_of_each():
    r = np.random.default_rng(5)
    pairs = []
    for n in r.integers(0, 900, 300).tolist():
        a = "".join(r.choice(list("abcde \xe9"), n))
        b = list(a)
        for _ in range(int(r.integers(0, n // 6 + 2))):
            k = int(r.integers(0, len(b) + 1))
            b[k : k + int(r.integers(0, 2))] = r.choice(list("abz"), int(r.integers(0, 2))).tolist()
        pairs.append((a, "".join(b)) if n % 2 else ("".join(b), a))
    limits = np.array([max(len(a), len(b)) // 10 for a, b in pairs])
    near = [L.edit_distance(a, b) <= k for (a, b), k in zip(pairs, limits.tolist())]
    assert 30 < sum(near) < 270
    assert L.within([(a.encode("latin-1"), b.encode("latin-1")) for a, b in pairs], limits).tolist() == near
    assert L.similar_pairs(pairs).tolist() == [L.similar(a, b) for a, b in pairs]


def test_pairs_of_a_bucket_are_not_compared_one_by_one(monkeypatch):
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdefgh"), 8)) for _ in range(40)]
    lines = [" ".join(words[:k] + ["".join(r.choice(list("ijklmn"), 8)) for _ in range(6)] + words[k + 6 :]) for k in r.integers(0, 34, 80).tolist()]
    lines += [x[:-1] + "z" for x in lines[:40]]
    end = np.cumsum([len(x) + 1 for x in lines]) - 1
    simhash, _, _ = L.signatures(*L.line_words("\n".join(lines).encode(), np.append(0, end[:-1] + 1)))
    contents = [{"line": x, "simhash": int(v)} for x, v in zip(lines, simhash.view(np.int64))]
    calls, one = [], L.similar
    monkeypatch.setattr(L, "similar", lambda *a: calls.append(a) or one(*a))
    forest = L.verified(list(range(len(lines))), contents)
    assert {tuple(sorted(p)) for p in forest} >= {(k, 80 + k) for k in range(40)} and len(calls) < 100
