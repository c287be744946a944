import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.config_packing import Pricing, best_fit, pack, places, plan_packing, program
from tessera.llm.encoding import encoder

from .conftest import ODD


def used(plan):
    c = Counter()
    for content, n in plan:
        for l in content:
            c[l] += n
    return c


def test_pricing_is_the_knapsack_optimum():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 5, 7, 11])
    value = rng.random(4)
    p = Pricing(lengths, 40)
    p.solve(value)
    best = [0.0] * 41
    for c in range(1, 41):
        best[c] = max([best[c - l] + v for l, v in zip(lengths, value) if l <= c] + [best[c - 1]])
    assert abs(max(p.best[: 41]) - best[40]) < 1e-9
    config = p.configuration(40)
    assert sum(lengths[i] for i in config) <= 40 and abs(sum(value[i] for i in config) - p.best[40]) < 1e-9


def test_plans_hold_the_histogram_and_are_tight():
    rng = random.Random(1)
    for _ in range(12):
        cap = rng.choice([10, 64, 300])
        h = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        plan = plan_packing(h, cap, rounds=60)
        assert used(plan) == Counter(h) and all(sum(c) <= cap for c, _ in plan)
        total = sum(n for _, n in plan)
        plain = sum(n for _, n in best_fit([], dict(h), cap))
        assert total >= -(-sum(l * n for l, n in h.items()) // cap) and total <= plain * 1.05 + 3


def test_perfect_fit_is_found():
    assert sum(n for _, n in plan_packing({1025: 100, 1023: 100, 512: 40}, 2048)) == 110


@pytest.mark.parametrize("n", [10_000, 250_000, 25_000_000])
def test_the_program_places_most_tokens(n):
    """Lengths spread as documents' are; never more sequences than by best fit alone."""
    rng = np.random.default_rng(n)
    sizes = np.clip(rng.lognormal(6.2, 1.1, 200_000).astype(int), 2, 40_000) % 2048
    counts = np.bincount(sizes, minlength=2048) * (n / len(sizes))
    h = {l: int(c + rng.random()) for l, c in enumerate(counts) if l and c + rng.random() >= 1}
    h = {l: c for l, c in h.items() if c}
    lengths = np.array(sorted(h))
    rest = np.array([h[l] for l in lengths])
    total = int((lengths * rest).sum())
    made = program(lengths, rest, 2048, 60)
    assert sum(k * sum(c) for c, k in made) > total * 0.75
    plan = plan_packing(h, 2048)
    assert used(plan) == Counter(h) and all(sum(c) <= 2048 for c, _ in plan)
    assert sum(k for _, k in plan) <= sum(k for _, k in best_fit([], dict(h), 2048))


def test_lengths_that_never_fill_a_sequence():
    assert sum(n for _, n in plan_packing({1000: 1000}, 2048)) == 500
    assert sum(n for _, n in plan_packing({1500: 7, 600: 9}, 2048)) == 10


def test_places_are_gapless():
    keys, seqs, offsets = places([([5, 3], 4), ([3, 3], 2)])
    assert sorted(zip((keys >> 40).tolist(), offsets.tolist())) == [(3, 0), (3, 3), (3, 5), (5, 0)]


def check(rows, docs, cap):
    e = encoder("word_bpe_49k.json")
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    want = Counter()
    for doc, text in docs:
        ids = np.array(e.tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), cap)):
            part = ids[a : a + cap]
            want[doc, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_table(odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check(pack(odd, capacity=2048).collect(), docs, 2048)
    check(pack(odd, capacity=16, rounds=20).collect(), docs, 16)
    assert pack(empty).count() == 0 and len(ODD) == 16
