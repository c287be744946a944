"""Word-shingle sets of texts as sorted 64-bit hashes, and bitmaps of fixed size over such hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_hash = xxhash.xxh3_64_intdigest


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word, so that order by hash is order by chance."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


#: Characters that are hashed with one table of powers.
HASHED = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_made: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse; kept up to a fixed size only."""
    if n > HASHED or "powers" not in _made:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, HASHED), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        if n > HASHED:
            return made[0][:n], made[1][:n]
        _made["powers"] = made
    return _made["powers"][0][:n], _made["powers"][1][:n]


def run_hashes(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each code[first:last], runs in order, wherever they stand."""
    out = np.zeros(len(first), np.uint64)
    k = 0
    while k < len(first):  # as many runs as one table of powers serves, or a single longer one
        a = int(first[k])
        m = max(k + 1, int(np.searchsorted(last, a + HASHED, side="right")))
        part = code[a : int(last[m - 1])]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=sums[1:])
        begin = first[k:m] - a
        out[k:m] = (sums[last[k:m] - a] - sums[begin]) * down[begin]
        k = m
    return mixed(out)


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of every ``k`` words (A-Z lower-cased, cut at ASCII blanks); fewer words are one shingle."""
    words = np.array([_hash(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)
    if not len(words):
        return words
    if len(words) < k:
        h = np.array([len(words)], np.uint64)
        for i in range(len(words)):
            h = mixed((h + words[i : i + 1]) * _ODD[0])
        return h
    h = words[: len(words) - k + 1] * _ODD[0]
    for i in range(1, k):
        h = h + words[i : len(words) - k + 1 + i] * _ODD[i % 5]
    return np.unique(mixed(h))


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), ">i8")[0])


def bitmap(hashes: DataFrame, n_bits_log: int) -> np.ndarray:
    """uint64 words of a bitmap that has the top ``n_bits_log`` bits of the long column ``h`` set; at most 2**(n_bits_log - 6) rows reach the driver."""
    top = F.shiftrightunsigned("h", 64 - n_bits_log)
    rows = hashes.groupBy(F.shiftrightunsigned(top, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (top % 64).cast("int"))).alias("bits"))
    out = np.zeros(1 << (n_bits_log - 6), np.uint64)
    got = rows.toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    n_bits_log = int(len(words)).bit_length() + 5
    top = hashes >> np.uint64(64 - n_bits_log)
    return (words[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) > 0


def bits_for(n: int, least: int = 12, most: int = 27) -> int:
    """About 16 bits for each of n members, within bounds; beyond them a bitmap only says yes more often."""
    return min(most, max(least, (16 * max(1, n)).bit_length()))
