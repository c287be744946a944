"""Exact byte-pair token counts of every prefix of a text by prefix dynamic programming.

A token sequence is the byte-pair encoding of its bytes exactly if every adjacent pair of it is the
encoding of that pair's bytes.  So the last token of a prefix is the one token that ends there and
agrees with the last token of the prefix before it, and the count is one more than that prefix's.
One pass over a pre-token, of constant work for each byte, gives the counts of all its prefixes; they
are stored, and running sums over pre-tokens give those of the text.  Truncation and budget questions
are then lookups, without encoding again.

A text cut within a pre-token has that pre-token's prefix as its last one, with three exceptions, which
``prefix_counts`` handles: blanks at the cut are one pre-token, a contraction is one only when whole, and so
is a special string.

Null texts count as empty.  Equal to the tokenizers library without added begin or end tokens;
strings of special tokens inside a text count as that token, as is the library's default.  Words of any
length and any number of special strings take time in proportion to the text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import arrow_map, documents
from tessera.llm.encoding import BYTE_LEVEL, UNSURE, Remembering, byte_letters, load, model_of

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Words whose count a worker remembers, about 100 bytes each.
WORDS = 600_000
#: Bytes at a word's begin where looking for tokens costs less than looking how far back they may reach.
NEAR = 12

#: Unicode's blanks, as the pattern of the tokenizer has them.
BLANKS = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
#: Two blanks of which the second is a space: only there does cutting at spaces part a run of blanks.
_RUNS = ("  ", "\n ", "\t ", "\r ")


class PrefixCounter:
    """Counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, name: str = TOKENIZER):
        model, letters = model_of(name), byte_letters()
        self.tok = load(name)
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile("(?!)")
        self.id = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in set(special)}
        self.ends = {b[k:] for b in self.id for k in range(len(b))}  # what a token may end with
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            l, r = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.id[l + r]
            self.merge[self.id[l], self.id[r]] = rank
            if made not in self.rank:
                self.rank[made], self.parts[made] = rank, (self.id[l], self.id[r])
        self.agree = Remembering(lambda pair: self.keeps(*pair), 400_000)
        self.alone = Remembering(lambda t: t not in self.rank or self.keeps(*self.parts[t], self.rank[t]))
        self.tables = Remembering(self._table, 20_000)
        self.words = Remembering(lambda w: self.prefixes(w.encode())[-1], WORDS)
        self.chunks = Remembering(self._chunk)

    def keeps(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether no merge before rank ``limit`` joins bytes of a with bytes of b, that is, whether a, b are encoded as such.

        Undoes the merges of both sides, last one first; a merge across the border must not come before the one undone.
        """
        rank, parts, merge = self.rank, self.parts, self.merge
        while True:
            if merge.get((a, b), 1 << 61) < limit:
                return False
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x > y:
                limit, a = x, parts[a][1]
            elif y >= 0:
                limit, b = y + 1, parts[b][0]  # of equal merges the one further left comes first
            else:
                return True

    def prefixes(self, data: bytes) -> list[int] | array:
        """Token count of data[:1], data[:2], ... of one pre-token."""
        made = list if len(data) < 1 << 16 else lambda x: array("i", x)
        last, counts = made([0]), made([0])
        get, ends, agree, alone = self.id.get, self.ends, self.agree, self.alone
        for i in range(1, len(data) + 1):
            low = 0
            if i > NEAR:  # from here on, as far back as a token may reach
                low = i - 1
                while low and data[low - 1 : i] in ends:
                    low -= 1
            for k in range(low, i):
                t = get(data[k:i])
                if t is not None and (agree[last[k], t] if k else alone[t]):
                    last.append(t)
                    counts.append(counts[k] + 1)
                    break
            else:
                raise ValueError("no token ends a prefix; the vocabulary lacks a byte")
        return counts[1:]

    def _table(self, word: str) -> np.ndarray:
        """Counts of word[:1], word[:2], ... of one pre-token."""
        data = word.encode()
        counts = np.array(self.prefixes(data), np.int32)
        if len(data) == len(word):
            return counts
        starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        return counts[np.append(np.flatnonzero(starts)[1:], len(data)) - 1]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not UNSURE.search(text):
            return BYTE_LEVEL.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str, out: np.ndarray, base: int = 0) -> tuple[int, int, int]:
        """Fills ``out`` with base and the counts of text[:1], ...; returns that of the text, the start of its last pre-token that isn't blank, and the count before it."""
        at, run, run_base, start, start_base = 0, 0, base, 0, base
        for w in self.split(text):
            k, table = len(w), self.tables[w]
            out[at : at + k] = table
            out[at : at + k] += base
            if w[0] in BLANKS:
                if run < at:  # at a cut, all blanks before it are one pre-token
                    n = k if w[-1] in BLANKS else 1
                    out[at : at + n] = run_base + self.tables[text[run : at + n]][at - run :]
            elif w in CONTRACTIONS:
                for n in range(1, k):
                    out[at + n - 1] = base + sum(self.words[c] for c in w[:n])
            before, at, base = base, at + k, base + int(table[-1])
            if w[-1] not in BLANKS:
                run, run_base, start, start_base = at, base, at - k, before
        return base, start, start_base

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text."""
        out = np.zeros(len(text) + 1, np.int32)
        base, at = 0, 0
        for m in self.special.finditer(text):
            base, start, before = self._plain(text[at : m.start()], out[at + 1 :], base)
            q = at + start  # a part of a special string is plain text, and may join the pre-token before it
            plain = np.zeros(m.end() - q, np.int32)
            self._plain(text[q : m.end()], plain, before)
            out[m.start() + 1 : m.end()] = plain[m.start() - q : -1]
            base, at = base + 1, m.end()
            out[at] = base
        self._plain(text[at:], out[at + 1 :], base)
        return out

    def _chunk(self, chunk: str) -> int | None:
        """Count of a space and what follows it; None where only the whole text tells."""
        if UNSURE.search(chunk) or "<|" in chunk:
            return None
        return sum(map(self.words.__getitem__, BYTE_LEVEL.findall(" " + chunk)))

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the largest p for which text[:p] has at most ``budget``."""
        if not any(r in text for r in _RUNS):  # then each space starts a pre-token, and the parts between are apart
            first, *rest = text.split(" ")
            try:
                counts = [self.chunks[first] and sum(map(self.words.__getitem__, BYTE_LEVEL.findall(first))), *map(self.chunks.__getitem__, rest)]
                total = sum(counts)
                if total <= budget:
                    return total, len(text)
                before = list(accumulate(counts, initial=0))
                k = bisect_right(before, budget) - 1
                part = rest[k - 1] if k else first
                counts = self.prefix_counts(" " + part if k else part)
                at = sum(map(len, rest[: k - 1])) + k - 1 + len(first) if k else 0
                return total, at + int(np.flatnonzero(counts <= budget - before[k])[-1])
            except TypeError:
                pass
        counts = self.prefix_counts(text)
        return int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])


class PrefixTable:
    """The stored counts of all prefixes of one text, and what they answer."""

    def __init__(self, counter: PrefixCounter, text: str | None):
        self.counts = counter.prefix_counts(text or "")

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, p: int) -> int:
        """Token count of text[:p]."""
        return int(self.counts[p])

    def fit(self, budget: int) -> int:
        """Largest p with at(p) <= budget."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(name: str = TOKENIZER) -> PrefixCounter:
    if name not in _counters:
        _counters[name] = PrefixCounter(name)
    return _counters[name]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_bytes, the bytes of the longest prefix within ``limit``.

    One output row per input row; null and empty texts give zeros; other columns are ignored.
    """

    def run(ids, texts):
        c = counter(tokenizer)
        n_bytes, n_tokens, fit = [], [], []
        for text in texts:
            text = text or ""
            total, p = c.count_and_fit(text, limit)
            n_bytes.append(len(text.encode()))
            n_tokens.append(total)
            fit.append(n_bytes[-1] if p == len(text) else len(text[:p].encode()))
        return ids, n_bytes, n_tokens, [n > limit for n in n_tokens], fit

    return arrow_map(
        docs, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long", run, "doc_id", "text"
    )


def prefix_tables(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and counts, the token counts of the prefixes of 0, 1, 2, ... characters, for storing next to the texts."""

    def run(ids, texts):
        return ids, [PrefixTable(counter(tokenizer), t).counts for t in texts]

    return arrow_map(docs, "doc_id long, counts array<int>", run, "doc_id", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
