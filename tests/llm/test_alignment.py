import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm.token_alignment import align, encoded, groups, pair_counts, vocabularies


def letters():
    """Byte-level letters by the rule that GPT-like files use, written out."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in own}
    for b in range(256):
        if b not in own:
            out[chr(256 + len(out) - len(own))] = b
    return out


def brute(texts):
    """The contract's columns of each text by nested loops."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte = letters()
    made, counts = [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        data = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        j0 = 0
        links = []
        for i, (x, y) in enumerate(spans[0]):
            while j0 < len(spans[1]) and spans[1][j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        parts, i, j = [], 0, 0
        for e in ends:
            own = [[], []]
            while i < len(a) and spans[0][i][1] <= e:
                own[0].append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= e:
                own[1].append(str(b[j]))
                j += 1
            parts.append("|".join(map(",".join, own)))
        made.append((len(a), len(b), len(ends), links, ";".join(parts)))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(n, m, g, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if n else "") for n, m, g, links, s in made], counts


def rows(df):
    return sorted(((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect()))


def made_texts():
    r = random.Random(3)
    words = ["the", "naïve", "Straße", "漢字", "12345", "<|endoftext|>", "<unk>", "  ", "\n\n", "\t", "tokenizers'll", "ﬁne", "é", "́", "🙂", "▁", "x" * 40, "\x00", "​", "don't"]
    return ["".join(r.choice(words) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 40))) for _ in range(150)]


@pytest.fixture(scope="module")
def texts(spark):
    made = made_texts()
    made += made[:20] + ["and and and and " * 50] * 60  # copies and one very common pair
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], "doc_id long, text string, pair string").repartition(5), made


def test_odd_rows(odd):
    """Nulls, empties, special strings, control characters, a long text, repeated rows, no id, clashing columns."""
    own = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute([t for _, t in own])[0]
    got = align(odd)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == sorted((-1 if d is None else d, *w) for (d, _), w in zip(own, want))


def test_against_nested_loops(texts):
    df, made = texts
    want = [(i, *w) for i, w in enumerate(brute(made)[0])]
    assert rows(align(df)) == want
    assert any(w[1] == 0 for w in want)  # a text that its tokens don't give back


def test_many_pairs_take_the_join(texts):
    """Beyond the bound, chunks ask for their pairs; the rows are the same."""
    df, _ = texts
    assert rows(align(df, most=0)) == rows(align(df))


def test_pair_counts(texts):
    df, made = texts
    got = {(r.a, r.b): r.n for r in pair_counts(encoded(df)).collect()}
    assert got == dict(brute(made)[1])


def test_groups_cover_the_text(texts):
    df, made = texts
    v = vocabularies()
    for r in groups(df).collect():
        if r.groups:
            for g in r.groups.split(";"):
                a, b = (x.split(",") for x in g.split("|"))
                assert b"".join(v.a_bytes[int(i)] for i in a) == b"".join(v.b_bytes[int(i)] for i in b)
            whole = b"".join(v.a_bytes[int(i)] for g in r.groups.split(";") for i in g.split("|")[0].split(","))
            assert whole == (" " + made[r.doc_id]).encode()


def test_empty(empty):
    assert align(empty).count() == 0
    assert align(empty, most=-1).count() == 0
