"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (one to three letters, word ends marked) by rank.  A
document's own most frequent n-grams are compared with each profile by the out-of-place distance: the
sum over its n-grams of how far each stands from its place in the profile, or the profile's size if
it isn't there.  The nearest language wins; ties go to the first name in order.

Training rows are counted in every task before anything is shuffled, so a frequent language costs no
more than its distinct n-grams.  All training rows count, whole texts throughout.

Null texts and texts without a letter give ``und`` with score 0; so does every text if there is
nothing to learn from.  Rows whose lang is null teach nothing.  Repeated rows count each time.
Rows without a doc_id teach nothing and aren't held out.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, documents

PROFILE = 400
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the text's n-grams, 21 bits a letter (0: a word's end), and their counts."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.concatenate([[0], np.where(letters()[code], code, 0), [0]])
    code = code[(code > 0) | (np.concatenate([[1], code[:-1]]) > 0)]  # one mark between words
    one = code[code > 0]
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    three = three[code[1:-1] > 0]  # not across words
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, ngram, n) over rows with a text and a lang."""
    schema = pa.schema([("lang", pa.string()), ("ngram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def settle(lang: str) -> None:
            parts = waiting.pop(lang, []) + ([sums[lang]] if lang in sums else [])
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums[lang] = codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting.setdefault(lang, []).append(ngrams(text))
                if len(waiting[lang]) >= 256:
                    settle(lang)
        for lang in list(waiting):
            settle(lang)
        for lang, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], schema=schema)

    known = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    return known.mapInArrow(run, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language: ``size`` codes at most each, most frequent first."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    rows = ngram_counts(docs).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in rows.orderBy("lang", "rank").collect():  # size rows for each language
        out.setdefault(r.lang, []).append(r.ngram)
    return out


class Ranks:
    """Profiles as one table of ranks, for lookups of many n-grams at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text or "")
        if not self.langs or not len(codes) or codes[-1] == 0:
            return UNKNOWN, 0.0
        own = top(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == own[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        rank = self.rank[:, at]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (1: the profile's own order, 0: nothing in common)."""

    def run(ids, held, texts, model=[]):
        if not model:
            model.append(Ranks(profiles, size))
        made = [model[0].predict(t) for t in texts]
        return ids, held, [m[0] for m in made], [m[1] for m in made]

    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return arrow_map(rows, "doc_id long, held_out boolean, lang_pred string, score double", run, "doc_id", "held_out", "text")


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Learns from the rows that aren't held out, and predicts all rows."""
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return predict(docs, fit(learn, size), size)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
