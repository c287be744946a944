import random
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import blocks
from tessera.llm import jaccard_join as J
from tessera.llm.common import connected_components
from tessera.llm.shingles import shingle_set


def words(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def brute(docs):
    """Components over all pairs, from the words themselves."""
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least[root(i)], d)
    return {d: (len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)}


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**9))
def test_tree_finds_all_connections(seed):
    rng = random.Random(seed)
    base = [[rng.randrange(10**9) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 4))]
    sets = []
    for _ in range(rng.randint(2, 14)):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                b[rng.randrange(len(b))] = rng.randrange(10**9)
        sets.append(np.unique(np.array(b, np.uint64)))
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    got = J.PrefixTree(sets).links()
    assert all(link(sets[a], sets[b]) for a, b in got)
    assert groups(got) == groups([(i, j) for i in range(len(sets)) for j in range(i) if link(sets[i], sets[j])])


def test_shingles():
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b c")) == len(shingle_set("a b c d e")) == 1
    assert shingle_set("A b c d E")[0] == shingle_set("a B\tc\nd  e")[0] != shingle_set("a b c d f")[0]
    assert shingle_set("a b")[0] != shingle_set("b a")[0]
    assert len(shingle_set("a b c d e f")) == 1  # not an ASCII blank


def fixture(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for d in range(n):
        if docs and rng.random() < 0.5:
            w = words(rng.choice(docs)[1])
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 8, 9, 40, 200]))]
            if rng.random() < 0.4:
                w += passage
        docs.append((d, " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [blocks.BLOCK, 300])
def test_against_brute_force(spark, monkeypatch, block):
    if block != blocks.BLOCK:  # many blocks for each bucket
        real = blocks.buckets
        monkeypatch.setattr(J, "buckets", lambda m, p: real(m, p, block))
    docs = fixture(random.Random(block), 160)
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_chains_of_buckets(spark):
    """C and x are near copies; C shares a passage with the smaller D, and D another one with the smaller E, none of which x has."""
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(12):
        p, q = fresh(9), fresh(9)
        c = fresh(85) + p
        x = c + fresh(2)
        x[-7] += "y"  # the middle of p: none of its shingles is left
        docs += [" ".join(w) for w in (fresh(77) + q, fresh(36) + p + fresh(36) + q, c, x)]
    docs = list(enumerate(docs))
    want = brute(docs)
    assert all(want[d][1] == (d - 1 if d % 4 == 3 else d) for d, _ in docs)
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_odd_texts(odd, empty):
    rows = J.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and J.jaccard_components(empty).count() == 0
    docs = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = brute(sorted(docs.items()))
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 540)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 540)}


def test_prefix_bound():
    for n in range(1, 200):
        for m in range(n, 260):
            if J.needed(n, m) <= n:  # linked sets share one of the first shingles of each
                assert J.prefix_length(n) >= n - J.needed(n, m) + 1 and J.prefix_length(m) >= m - J.needed(n, m) + 1


def test_rows_without_an_id_are_bridges(spark):
    words_ = [f"w{i}" for i in range(60)]
    a, b, c = words_[:], words_[:], words_[:]
    b[58:] = ["x", "y"]  # near both
    c[:2], c[58:] = ["p", "q"], ["x", "y"]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, "alone here with some six words"), (None, None)]
    plain = {i: x for i, x in enumerate([(1, rows[0][1]), (3, rows[1][1]), (2, rows[2][1])])}
    assert brute(list(plain.values())) == {1: (56, 1), 3: (56, 1), 2: (56, 1)}
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 0), (0, 56, 1), (1, 56, 1), (2, 56, 1)]


@pytest.mark.parametrize("case", ["dense", "star", "sparse"])
def test_large_buckets_take_bounded_time(case):
    rng = np.random.default_rng(5)
    if case == "dense":  # nothing links
        sets = [np.sort(rng.choice(60, 40, replace=False)).astype(np.uint64) for _ in range(4000)]
    elif case == "star":
        base = np.arange(100, dtype=np.uint64)
        sets = [np.append(base[base != i % 100], np.uint64(1000 + i)) for i in range(40_000)]
    else:
        sets = [np.unique(rng.integers(0, 10**6, 60).astype(np.uint64)) for _ in range(8000)]
    began = time.process_time()
    links = J.PrefixTree(sets).links()
    assert time.process_time() - began < 40
    assert len(links) == len(sets) - 1 if case == "star" else len(links) < len(sets)
