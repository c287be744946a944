"""Packing by a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence.  The program "configurations, none
wasting room, that hold every length's count" is solved by multiplicative weights: lengths that are
still poorly covered weigh more, the longer the more, a knapsack dynamic program prices the configurations
of largest value, and these enter the solution in small steps, none beyond what is left of its lengths.
The solution is rounded down and the program solved again for what is left; in the last round steps are
whole numbers.  The shortest pieces, ``RESERVED`` of all tokens, and the few that no configuration took
fill the gaps, longest first, each in the fullest place where it fits.

Only the histogram (at most ``capacity`` rows) reaches the driver.  Pieces get their place by their
rank among the pieces of their length, numbered in parallel over salted groups, so a length that
many pieces share is never gathered in one task; texts and ids are never shuffled.

Null texts are empty documents: they hold only the closing id.  Repeated rows are packed one by one.
An empty table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, checkpointed, documents
from tessera.llm.encoding import encoder

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
CLOSING = 0
#: How fast weights fall with what is covered.
RATE = 8.0
#: What weight adds to the value of filled room, and the share of a sequence that a configuration may leave free at first.  The
#: second and third are for histograms where long pieces find too little to go with; the plan of fewest sequences is taken.
SETTINGS = ((0.05, 0.0), (1.0, 0.1), (20.0, 0.5))
#: Share of all tokens that the shortest pieces kept for the gaps may have.
RESERVED = 0.01
#: Pieces of one length that are numbered in one task, about.
GROUP = 500_000


class Pricing:
    """Unbounded knapsack over the lengths in use: best value of every capacity, and what attains it."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")

    def solve(self, value: np.ndarray) -> None:
        best = np.zeros(self.capacity + 1)
        last = np.full(self.capacity + 1, -1)
        for c in range(1, self.capacity + 1):
            k = self.fitting[c]
            if k:
                v = best[c - self.lengths[:k]] + value[:k]
                j = int(v.argmax())
                best[c], last[c] = v[j], j
        self.best, self.last = best, last

    def configuration(self, room: int) -> list[int]:
        """Indices of lengths of the best filling of ``room``."""
        out = []
        while room > 0 and self.last[room] >= 0:
            out.append(int(self.last[room]))
            room -= int(self.lengths[self.last[room]])
        return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float, rounds: int, whole: bool, waste: int, bonus: float) -> dict[tuple[int, ...], float]:
    """Multiplicative weights: {configuration: amount} whose lengths stay within ``counts``; whole numbers if ``whole``."""
    left = counts.astype(float)
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        use = np.flatnonzero(left >= (1 if whole else counts * 1e-3))
        if not len(use):
            break
        own, share = lengths[use], left[use] / counts[use]
        weight = np.exp(RATE * (share - share.max()))
        pricing = Pricing(own, capacity)
        pricing.solve(own / capacity * (1 + bonus * weight * own / capacity))  # room filled first, then what is behind
        placed = False
        for j in np.argsort(-own):
            if left[use[j]] < 1 if whole else share[j] < share.max() - step:
                continue
            config = [int(j), *pricing.configuration(capacity - int(own[j]))]
            if own[config].sum() < capacity - waste:
                continue
            uses = Counter(use[config].tolist())
            most = min(left[i] / k for i, k in uses.items())
            if whole:
                amount = max(1, int(step * most)) if most >= 1 else 0
            else:
                amount = min(most, step * min(counts[i] / k for i, k in uses.items()))
            if amount > 0:
                amounts[tuple(sorted(own[config].tolist()))] += amount
                for i, k in uses.items():
                    left[i] -= k * amount
                placed = True
        if not placed:
            break
    return amounts


def program(lengths: np.ndarray, rest: np.ndarray, capacity: int, rounds: int, bonus: float = SETTINGS[0][0], free: float = 0.0) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, number of such sequences)] of the rounded program; lowers ``rest`` by what they hold."""
    plan: list[tuple[list[int], int]] = []
    total = int((lengths * rest).sum())

    def place(whole: bool, waste: int) -> int:
        use = np.flatnonzero(rest)
        tokens = 0
        for config, amount in solve(lengths[use], rest[use], capacity, 0.25 if whole else 0.1, rounds, whole, waste, bonus).items():
            if (n := int(amount + 1e-9)) > 0:
                plan.append((list(config), n))
                tokens += n * sum(config)
                for l, k in Counter(config).items():
                    rest[np.searchsorted(lengths, l)] -= n * k
        return tokens

    least = int(free * capacity)
    for _ in range(3):
        if place(False, least) * 20 < total:
            break
    place(True, least)
    for waste in (capacity // 64, capacity // 16, capacity // 4, capacity):  # lengths that rarely add up to the capacity
        if (lengths * rest).sum() * 2 < total:
            break
        place(True, waste)
    return plan


def plan_packing(histogram: dict[int, int], capacity: int, rounds: int = 60) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, number of such sequences)] that hold the histogram exactly."""
    left = {l: n for l, n in histogram.items() if n > 0}
    if any(l < 1 or l > capacity for l in left):
        raise ValueError("lengths must be within 1 and the capacity")
    plan: list[tuple[list[int], int]] = []
    if full := left.pop(capacity, 0):
        plan.append(([capacity], full))
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[l] for l in lengths])
        tokens = np.cumsum(lengths * counts)
        rest = np.where(tokens <= RESERVED * tokens[-1], 0, counts)
        reserved = counts - rest
        plans = []
        for bonus, free in SETTINGS:
            after = rest.copy()
            made = program(lengths, after, capacity, rounds, bonus, free)
            gaps = {int(l): int(n) for l, n in zip(lengths, after + reserved) if n}
            plans.append(best_fit(made, gaps, capacity))
            if sum(n for _, n in plans[-1]) * capacity < tokens[-1] + capacity:
                break  # as few as the tokens need
        plan += min(plans, key=lambda p: sum(n for _, n in p))
    return plan


def best_fit(plan, items: dict[int, int], capacity: int):
    """Adds items, longest first, to the sequences of least sufficient room; equal sequences move together."""
    open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    rooms: list[int] = []
    from bisect import bisect_left, insort

    def put(content, n):
        room = capacity - sum(content)
        if not open_[room]:
            insort(rooms, room)
        open_[room].append((content, n))

    for content, n in plan:
        put(content, n)
    for l in sorted(items, reverse=True):
        n = items[l]
        while n:
            k = bisect_left(rooms, l)
            if k == len(rooms):
                fill = min(capacity // l, n)
                put([l] * fill, n // fill)
                n -= n // fill * fill
                continue
            room = rooms[k]
            content, m = open_[room].pop()
            if not open_[room]:
                rooms.pop(k)
            used = min(m, n)
            if m > used:
                put(content, m - used)
            put([*content, l], used)
            n -= used
    return [x for v in open_.values() for x in v]


def places(plan) -> tuple[np.ndarray, ...]:
    """Per occurrence of a length in the plan: key (length << 40 | first rank), first sequence, offset; by key."""
    rank: dict[int, int] = defaultdict(int)
    keys, seqs, offsets, base = [], [], [], 0
    for content, n in plan:
        at = 0
        for l in sorted(content, reverse=True):
            keys.append((l << 40) | rank[l])
            seqs.append(base)
            offsets.append(at)
            rank[l] += n
            at += l
        base += n
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, seqs, offsets))


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with the closing id, cut at ``capacity``."""

    def run(ids, texts):
        out = ([], [], [], [], [])
        enc = encoder(tokenizer)
        closing = CLOSING.to_bytes(4, "little")
        for doc, text in zip(ids, texts):
            data = enc.encode(text) + closing
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                for column, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(v)
        return out

    return arrow_map(docs, "doc_id long, piece int, start long, length long, ids_crc32 long", run, "doc_id", "text")


def ranked(pieces: DataFrame, longest: int, group: int = GROUP) -> DataFrame:
    """Adds rank, from 0, among the pieces of equal length: a rank within a salted group plus the groups before.

    ``longest`` is the count of the commonest length; there are so many salts that its groups have about ``group`` pieces.
    """
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(8, -(-longest // group)))).cast("int")
    salted = pieces.withColumn("salt", salt)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("within", F.row_number().over(own) - 1)
    return numbered.join(groups, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("within"))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, rounds: int = 60) -> DataFrame:
    """Every piece with its sequence_id and offset; see the module's text.

    A full piece is a sequence by itself: its number, below 0, needs no rank and no shuffle.
    """
    pieces = checkpointed(cut_pieces(docs, tokenizer, capacity))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    histogram.pop(capacity, None)
    table = places(plan_packing(histogram, capacity, rounds))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, seqs, offsets = table
        want = (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64)
        k = np.searchsorted(keys, want, side="right") - 1
        return pd.DataFrame({"sequence_id": seqs[k] + want - keys[k], "offset": offsets[k]})

    columns = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    part = ranked(pieces.where(F.col("length") < capacity), max(histogram.values(), default=0)).withColumn("at", place("length", "rank"))
    full = pieces.where(F.col("length") == capacity)  # the checkpoint's rows, so numbers hold when a task is repeated
    return full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(
        part.select(*columns, "at.sequence_id", "at.offset")
    )


def op8_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
