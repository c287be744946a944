"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

1. Benchmark texts are cut into passages.  Document frequencies of their words are counted over the
   passages (fixed windows) of all documents, whole texts throughout.
2. A randomised SVD of the passages' TF-IDF rows gives a latent space: a random sketch, power
   iterations and the projected matrix are sums over rows, taken per partition and then added up.
3. Every document is read through windows of the benchmark's word lengths.  A window is a candidate
   for a passage if its TF-IDF mass in the benchmark's vocabulary is a fair share of the passage's and
   the cosine of the two in the latent space is at least ``COSINE``.  Window sums come from running
   sums over the text, so a long text costs as much per word as a short one.
4. A candidate is verified by the longest common subsequence of words within the passage's share of
   the text: at least ``LCS`` of the passage's words; or, for paraphrases, at least ``LCS_LOOSE`` of
   them if also ``ANSWER`` of the passage's most distinctive words (its answer) occur.

Documents are read as arrays of word numbers, made for many texts at once by rolling hashes; words become
strings only where a candidate is verified.  Benchmark passages are handled in blocks of ``BLOCK``, so what
is sent to the workers is bounded: documents are read once to count words and once for each block, each of
which has a latent space of its own.  Null or empty texts on either side match nothing.  Repeated rows of a
document give their matches once; ties go to the earliest window.  Documents without a doc_id are searched
and come out under a null doc_id; ``clean`` tells rows apart by doc_id and text, so of rows that share a
doc_id, or have none, only those go that match.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, checkpointed, documents, slices, table, trim
from tessera.llm.shingles import run_hashes

RANK = 64
OVERSAMPLE = 16
POWER = 2
COSINE = 0.6
MASS = 0.45
LCS = 0.6
LCS_LOOSE = 0.45
ANSWER = 0.75
ANSWER_WORDS = 8
PASSAGE = 48
BLOCK = 32_000
#: Words of a text that are searched at once.
SEGMENT = 16384
#: Words of a document's passage when document frequencies are counted.
COUNTED = 64

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def cut(words: list[str], size: int = PASSAGE) -> list[list[str]]:
    """Passages of a benchmark text: itself, or overlapping runs of ``size`` words if it is longer than 4/3 of that."""
    if len(words) * 3 <= size * 4:
        return [words] if words else []
    starts = list(range(0, len(words) - size, size // 2)) + [len(words) - size]
    return [words[a : a + size] for a in starts]


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, passage, words) of the benchmark table."""

    def run(ids, texts):
        out = ([], [], [])
        for item, text in zip(ids, texts):
            for k, words in enumerate(cut(words_of(text)) if item is not None else ()):
                for column, v in zip(out, (item, k, words)):
                    column.append(v)
        return out

    return arrow_map(benchmark, "item_id long, passage int, words array<string>", run, "item_id", "text").distinct()


_made: dict = {}


def _inside() -> np.ndarray:
    """By code point, whether it belongs to a word."""
    if "inside" not in _made:
        _made["inside"] = np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _made["inside"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts in order, and where each text's words begin (one more entry for the end)."""
    lower = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], _inside()[code], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in lower)])
    return run_hashes(code, first, last), np.searchsorted(first, at)


class Vocabulary:
    """Numbers of words, in the order of their hashes; ``size`` stands for all other words."""

    def __init__(self, words: list[str]):
        hashes = word_hashes(["\n".join(words)])[0]
        order = np.argsort(hashes)
        self.words = [words[i] for i in order]
        self.number = {w: i for i, w in enumerate(self.words)}
        self.size = len(words)
        self.bits = max(8, (4 * self.size).bit_length())
        self.hashes = np.append(hashes[order], np.zeros(1, np.uint64))
        slot = self.hashes[:-1] >> np.uint64(64 - self.bits)
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        at = self.first[slot]
        out = np.full(len(hashes), self.size, np.int32)
        for d in range(self.most):
            here = np.minimum(at + d, self.size)
            hit = (self.hashes[here] == hashes) & (here < self.size)
            out[hit] = here[hit]
        return out


def passage_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many passages of ``docs`` each word occurs, and the number of passages; every task adds up first."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = known.size
        sums, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                hashes, begin = word_hashes(part.column(0).to_pylist())
                n = np.diff(begin)
                each = -(-n // COUNTED)
                passage = (np.arange(len(hashes)) - np.repeat(begin[:-1], n)) // COUNTED + np.repeat(np.cumsum(each) - each, n)
                ids = known.numbers(hashes)
                inside = ids < size
                seen = np.unique(passage[inside] * size + ids[inside])
                sums += np.bincount(seen % size, minlength=size)
                total += int(each.sum())
        at = np.flatnonzero(sums)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*sums[at], total], pa.int64())], schema=schema)

    out, total = np.zeros(vocabulary.size, np.int64), 0
    for word, n in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        if word < 0:
            total = n
        else:
            out[word] = n
    return out, total


def tf_idf(words: list[str], known: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = Counter(w for w in words if w in known)
    ids = np.array([known[w] for w in counts], np.int64)
    return ids, np.fromiter(counts.values(), np.float64) * idf[ids]


def randomised_svd(rows: DataFrame, known: dict[str, int], idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF rows of ``words``; each step sums over rows in parallel."""
    sc = rows.sparkSession.sparkContext
    size, width = len(known), rank + OVERSAMPLE
    schema = pa.schema([("part", pa.int32()), ("sum", pa.binary())])

    def applied(q: np.ndarray) -> np.ndarray:
        """A' (A q), normalised rows."""
        sent = sc.broadcast((known, idf, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words_at, weights, basis = sent.value
            out = np.zeros((size, width))
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    ids, v = tf_idf(words, words_at, weights)
                    if len(ids):
                        v = v / np.linalg.norm(v)
                        out[ids] += np.outer(v, v @ basis[ids])
            for k in range(0, size, 4096):
                yield pa.RecordBatch.from_arrays([pa.array([k // 4096], pa.int32()), pa.array([out[k : k + 4096].tobytes()], pa.binary())], schema=schema)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    v = np.frombuffer(data).reshape(-1, width)
                    sums[part] = sums[part] + v if part in sums else v
            for part, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema=schema)

        parts = rows.select("words").mapInArrow(run, "part int, sum binary").repartition("part").mapInArrow(add, "part int, sum binary")
        out = np.zeros((size, width))
        for part, data in parts.collect():  # as large as the space itself, which is bounded by the block of passages
            v = np.frombuffer(data).reshape(-1, width)
            out[part * 4096 : part * 4096 + len(v)] = v
        return out

    q = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(1 + POWER):
        q, _ = np.linalg.qr(applied(q))
        if q.shape[1] < width:
            q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    small = q.T @ applied(q)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value)[:rank]
    return q @ turn[:, best[value[best] > 1e-9]]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        if m := at.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


class Words:
    """The words of a text, split when first asked for."""

    def __init__(self, text: str | None):
        self.text = text

    @cached_property
    def all(self) -> list[str]:
        return words_of(self.text)


def window_sizes(length: np.ndarray) -> np.ndarray:
    """The window of a passage of so many words: 8 times a power of the square root of 2, not below it."""
    step = np.ceil(np.maximum(0, 2 * np.log2(np.maximum(length, 8) / 8)) - 1e-9)
    return np.ceil(8 * 2 ** (step / 2) - 1e-9).astype(int)


class Retrieval:
    """A block of passages in their latent space, and the search of texts for them."""

    def __init__(self, items: list[tuple[int, int, list[str]]], vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray):
        known = vocabulary.number
        self.items, self.size = items, vocabulary.size
        self.idf = np.append(idf, 0.0)
        self.space = np.ascontiguousarray((space * idf[:, None]).T)
        ids = [np.array([known[w] for w in words]) for _, _, words in items]
        sums = np.array([self.space[:, i].sum(axis=1) for i in ids])
        self.latent = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.mass = np.array([(idf[i] ** 2).sum() for i in ids])
        size = window_sizes(np.array([len(i) for i in ids]))
        self.windows = []
        for w in np.unique(size).tolist():
            of = np.flatnonzero(size == w)
            self.windows.append((w, of, float(self.mass[of].min()) * MASS))
        self.longest = self.windows[-1][0]
        self.least = min(least for _, _, least in self.windows)
        self.answers = []
        for _, _, words in items:
            rare = sorted(set(words), key=lambda w: (-idf[known[w]], w))[:ANSWER_WORDS]
            self.answers.append(set(rare))

    def search(self, text: str | None, ids: np.ndarray) -> list[tuple[int, float, float, float, int]]:
        """(item_id, cosine, share of the subsequence, share of the answer, first word), the best for each item; ``ids`` are the text's word numbers."""
        words = Words(text)
        found: dict[int, tuple] = {}
        for low in range(0, len(ids), SEGMENT):
            self._search(words, ids[low : low + SEGMENT + self.longest], low, found)
        return [(item, *found[item]) for item in sorted(found)]

    def _search(self, words: Words, ids: np.ndarray, low: int, found: dict) -> None:
        """Windows that start in one segment of a text."""
        mass = np.concatenate([[0.0], np.cumsum(self.idf[ids] ** 2)])
        if mass[-1] < self.least:
            return
        sums = None
        for w, of, least in self.windows:
            start = np.arange(0, min(SEGMENT, max(1, len(ids) - w // 2)), max(1, w // 4))
            end = np.minimum(start + w, len(ids))
            weight = mass[end] - mass[start]
            heavy = np.flatnonzero(weight >= least)
            if not len(heavy):
                continue
            if sums is None:
                inside = ids < self.size  # other words have no place in the space
                before = np.concatenate([[0], np.cumsum(inside)])
                sums = np.zeros((len(self.space), before[-1] + 1))  # a row for each dimension: sums run along memory
                np.cumsum(np.take(self.space, ids[inside], axis=1), axis=1, out=sums[:, 1:])
            start, end, weight = start[heavy], end[heavy], weight[heavy]
            v = sums[:, before[end]] - sums[:, before[start]]
            v /= np.maximum(np.linalg.norm(v, axis=0), 1e-9)
            cosine = self.latent[of] @ v
            near = (cosine >= COSINE) & (weight >= MASS * self.mass[of][:, None])
            for j, k in zip(*(x.tolist() for x in np.nonzero(near))):
                self._verify(int(of[j]), float(cosine[j, k]), words, low + int(start[k]), low + int(end[k]), found)

    def _verify(self, p: int, cosine: float, words: Words, a: int, b: int, found: dict) -> None:
        item, _, passage = self.items[p]
        reach = max(4, len(passage) // 3)
        part = words.all[max(0, a - reach) : b + reach]
        share = lcs(passage, part) / len(passage)
        answer = len(self.answers[p].intersection(part)) / len(self.answers[p])
        if share >= LCS or (share >= LCS_LOOSE and answer >= ANSWER):
            if item not in found or (share, answer, cosine) > (found[item][1], found[item][2], found[item][0]):
                found[item] = (cosine, share, answer, a)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word: every document and item that match."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = checkpointed(passages(benchmark))
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word int"
    out = spark.createDataFrame([], schema)
    every = [r[0] for r in cuts.select(F.explode("words")).distinct().collect()]  # the benchmark's words
    if every:
        vocabulary = Vocabulary(sorted(every))
        n, total = passage_frequencies(docs, vocabulary)
        idf_of = dict(zip(vocabulary.words, (np.log((total + 1) / (n + 1)) + 1e-3).tolist()))
    n_blocks = max(1, -(-cuts.count() // block))
    cuts = cuts.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(n_blocks)))
    for k in range(n_blocks if every else 0):
        own = cuts.where(F.col("block") == k)
        items = sorted((r.item_id, r.passage, list(r.words)) for r in own.collect())  # about ``block`` passages
        if not items:
            continue
        vocabulary = Vocabulary(sorted({w for _, _, words in items for w in words}))
        idf = np.array([idf_of[w] for w in vocabulary.words])
        space = randomised_svd(own, vocabulary.number, idf, rank)
        sent = sc.broadcast((items, vocabulary, idf, space))

        def run(ids, texts, sent=sent, made=[]):
            if not made or made[0] is not sent:
                made[:] = [sent, sent.value[1], Retrieval(*sent.value)]
            hashes, begin = word_hashes(texts)
            numbers = made[1].numbers(hashes)
            rows = [(i, *m) for i, t, a, b in zip(ids, texts, begin.tolist(), begin[1:].tolist()) for m in made[2].search(t, numbers[a:b])]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]

        out = out.unionByName(arrow_map(docs, schema, run, "doc_id", "text"))
    best = F.max(F.struct("lcs_share", "answer_share", "cosine", (-F.col("first_word")).alias("first_word"))).alias("best")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share", (-F.col("best.first_word")).alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that match an item."""
    key = F.xxhash64("doc_id", "text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(found, "__key", "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
