"""Fuzzy line deduplication by SimHash, pigeonhole blocks and edit similarity.

1. Every line is normalised: lower case, ASCII signs and blanks as single blanks, runs of digits as
   one 0.  Lines of which nothing is left are never removed.  Equal normalised lines are one class.
2. A class has a 64-bit SimHash of its words.  Lines of 90 % edit similarity differ in far more bits than a
   pigeonhole on the bits of that hash could bridge, so the line itself is cut into blocks of words where the
   words' hashes have a local minimum; such places stay when the line changes elsewhere.  Each block has a
   SimHash, and changes in fewer places than there are blocks leave one of them as it is: lines meet where
   blocks agree.  A line takes part with the ``KEPT`` least of its blocks, lines of under ``PLACED`` words also with
   quarters of their words by place, so that three replaced words leave one of them.  Short lines instead take part
   with the SimHash of the whole and of the line without each of its words.
3. Lines that meet, and whose lengths and whole SimHashes don't rule out similarity, share a bucket.  There, lines
   that aren't connected yet are verified: one minus edit distance over the longer length (of UTF-8
   bytes) is at least ``SIMILAR`` percent, and, unless a line is short, ``SAME`` percent of the distinct words are
   in both.  The verdict on two lines depends on them alone, however many others share their bucket.
4. In every connected group of lines, the first occurrence by (doc_id, line) stays; the rest go.

Texts travel only for classes that have a candidate, once per bucket; a task tells of a line's blocks once,
so a very common line is a few rows.  Null texts have no lines.  Rows that repeat both doc_id and text count as
one document and lose the same lines.  Very long texts and lines take memory in proportion to the text, which
is given back.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import answered, block_links, buckets
from tessera.llm.common import arrow_map, checkpointed, connected_components, documents, release, trim
from tessera.llm.jaccard_join import Groups
from tessera.llm.shingles import bitmap, bits_for, in_bitmap, mixed, run_hashes

SIMILAR = 90
#: Lines of fewer words are short.
SHORT = 12
#: Words to either side over which a block's first word has the least hash.
RADIUS = 2
#: Blocks of a line that take part, and words of a block at most.
KEPT, LONGEST = 8, 128
#: Words of a block at least: for lines of any, 28 or more, and 44 or more words.  Long lines have blocks enough to choose rarer ones.
LEAST = (3, 4, 5)
#: Lines from ``SHORT`` to so many words take part with quarters by place as well: up to three replaced words leave one as it is.
QUARTERS, PLACED = 4, 28
#: Bits in which the SimHashes of similar lines may differ, for lines that aren't short.
FAR = 14
#: Percent of the distinct words of the line with fewer that similar lines, other than short ones, have in common, less one word.
SAME = 75
#: Bits of a line's trigrams: so many for each byte of a bucket's longest line, within bounds.
TRIGRAMS, TRIGRAM_BITS = 4, (512, 1 << 14)
#: Members of a block that are compared one by one; larger groups share a bucket as they are.
COMPARED = 256
#: Lines whose blocks a task remembers to have told.
TOLD = 1_000_000
#: Pairs of lines of up to so many bytes have their distances computed together, about so many bytes at once, unless they are few; columns between looks at who is done.
TOGETHER, BATCH, FEW, CHECKED = 4096, 1 << 20, 24, 32
#: Lines of a large group that meet those before them at once; rounds over a bucket's pairs that count on the nearest to be similar.
AT_ONCE, TRUSTED = 64, 3
#: Lines of a bucket that all meet each other, whatever blocks they share.
FEW_LINES = 4

_BLANK, _BREAK, _ZERO = 32, 10, 48
#: By byte: what it counts as.  Letters, the underscore and bytes of other characters stand for themselves.
_CLASS = np.full(256, _BLANK, np.uint8)
_CLASS[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz_\n":
    _CLASS[_c] = _c
_CLASS[48:58] = _ZERO
_ODD = 0x9E3779B97F4A7C15


def normalised(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts, one after the other with a line break between, normalised; begin and end of every line."""
    raw = np.frombuffer("\n".join([t or "" for t in texts]).lower().encode("utf-8", "surrogatepass"), np.uint8)
    c = _CLASS[raw]
    before = np.concatenate([np.array([_BREAK], np.uint8), c[:-1]])[: len(c)]
    again = ((c == _BLANK) & ((before == _BLANK) | (before == _BREAK))) | ((c == _ZERO) & (before == _ZERO))
    c = c[~again]
    end = np.append(np.flatnonzero(c == _BREAK), len(c))
    begin = np.concatenate([[0], end[:-1] + 1])
    end = end - ((end > begin) & (c[np.maximum(end, 1) - 1] == _BLANK) if len(c) else 0)  # a blank at a line's end
    return c.tobytes(), begin, end


def majority(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHashes from the sums of n words' bits."""
    return np.packbits(sums > (n // 2).astype(sums.dtype)[:, None], axis=1).view(np.uint64).ravel()


def added(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows from each place to the next; several counters that can't overflow are added as one number."""
    return np.add.reduceat(rows.view(np.uint64), at, axis=0).view(rows.dtype)


def line_words(data: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of lines that aren't empty: hashes, bytes, and the two bytes at either end; and the number of words of each line."""
    c = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (c != _BLANK) & (c != _BREAK), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    size = last - first
    at = lambda k: c[np.minimum(k, len(c) - 1)].astype(np.uint64)
    ends = (at(first) << np.uint64(24)) + (at(first + 1) << np.uint64(16)) + (at(last - 1) << np.uint64(8)) + at(np.maximum(last - 2, 0))
    return run_hashes(c, first, last), size, ends, np.diff(np.append(np.searchsorted(first, begin), len(first)))


def signatures(words: np.ndarray, size: np.ndarray, ends: np.ndarray, n: np.ndarray, percent: int = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHashes of lines of n words each; and the blocks of all lines in order, with the number of each line's."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    stop = np.cumsum(n)
    k = 0
    while k < len(n):  # bounds the bits held at once
        start = int(stop[k] - n[k])
        m = max(k + 1, int(np.searchsorted(stop, start + 50_000, side="right")))
        part = slice(start, int(stop[m - 1]))
        out.append(_signatures(words[part], size[part], ends[part], n[k:m], percent))
        k = m
    return tuple(np.concatenate(x) for x in zip(*out))


def _signatures(h: np.ndarray, letters: np.ndarray, ends: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    long = n >= SHORT
    cut = long[line]
    for d in range(1, RADIUS + 1):
        if len(h) > d:
            same = line[d:] == line[:-d]
            cut[d:] &= ~same | (h[d:] < h[:-d])
            cut[:-d] &= ~same | (h[:-d] <= h[d:])
    cut[first] = True
    since = np.flatnonzero(cut)
    since = np.arange(len(h)) - np.repeat(since, np.diff(np.append(since, len(h))))
    at = np.flatnonzero(since % LONGEST == 0)
    of, size = line[at], np.diff(np.append(at, len(h)))
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
    sums = added(bits, at)
    # with the sum of the words' hashes: else a block where one word has the majority would be that word
    each = majority(sums, size) + np.add.reduceat(h, at)
    wide = added(sums.astype(np.uint16 if n.max() < 1 << 16 else np.int64), np.searchsorted(at, first))
    whole = majority(wide, n)
    # long lines: the least blocks
    least = np.array(LEAST)[np.searchsorted((28, 44), n, side="right")]
    use = np.flatnonzero(long[of] & (size >= least[of]))
    value = mixed(each[use])
    order = np.lexsort((value, of[use]))
    value, of_value = value[order], of[use][order]
    rank = np.arange(len(value)) - np.searchsorted(of_value, of_value)
    value, of_value = value[rank < KEPT], of_value[rank < KEPT]
    # lines of a middling length: quarters by place, told apart by it and the line's length
    middle = np.flatnonzero(long & (n < PLACED))
    if len(middle):
        own = np.flatnonzero((long & (n < PLACED))[line])
        begin = (np.cumsum(n[middle]) - n[middle])[:, None] + n[middle][:, None] * np.arange(QUARTERS) // QUARTERS
        begin = begin.ravel()
        quarter = majority(added(bits[own], begin), np.diff(np.append(begin, len(own)))) + np.add.reduceat(h[own], begin)
        quarter += (n[middle][:, None] * QUARTERS + np.arange(QUARTERS)).ravel().astype(np.uint64) * np.uint64(_ODD)
        value, of_value = np.append(value, mixed(quarter)), np.append(of_value, np.repeat(middle, QUARTERS))
    # a line of few blocks, such as one word over and over, takes part with its SimHash too
    plain = np.flatnonzero(long & (np.bincount(of_value, minlength=len(n)) < 3))
    value, of_value = np.append(value, whole[plain]), np.append(of_value, plain)
    # short lines: the whole, and without each word
    # in lines of three words at most, the rest is common, so two bytes of the word left out go with it, at either end
    n_bytes = np.add.reduceat(letters, first) + n - 1
    short = (n < SHORT + 2) & (n_bytes * (100 - percent) >= 100)  # shorter ones have no similar ones; a line may lose a word or two
    few = np.flatnonzero(short)
    one = np.flatnonzero(short[line])
    total = np.add.reduceat(h, first)
    without = majority(wide[line[one]] - bits[one], np.maximum(n[line[one]] - 1, 1)) + total[line[one]] - h[one]
    tiny = n[line[one]] <= 3
    head, tail = (mixed(e[one][tiny] + np.uint64(k)) for e, k in ((ends >> np.uint64(16), 1 << 40), (ends & np.uint64(0xFFFF), 1 << 41)))
    value = np.concatenate([value, whole[few] + total[few], without[~tiny], without[tiny] + head, without[tiny] + tail])
    of_value = np.concatenate([of_value, few, line[one][~tiny], line[one][tiny], line[one][tiny]])
    order = np.argsort(of_value, kind="stable")
    return whole, value[order], np.bincount(of_value, minlength=len(n))


def line_key(line: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(line), "big", signed=True)


def edit_distance(a: str, b: str, limit: float = float("inf")) -> int:
    """Levenshtein distance by bit-parallel columns, after common ends are cut; any number over ``limit`` may stand for a larger one."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k : k + 64] == b[k : k + 64]:
        k += 64
    k = min(k, n)
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n, k = min(len(a), len(b)), 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    plus, minus, score = every, 0, len(a)
    bound = limit + len(b)  # a column lowers the score by one at most
    check = step = max(16, int(limit)) if limit < len(b) else len(b) + 1
    for j, c in enumerate(b):
        if j == check:
            if _beyond(plus, minus, j, len(a), len(b), int(limit)):
                return int(limit) + 1
            check += step
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (every & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        bound -= 1
        if score > bound:
            return score
        ph = (ph << 1 | 1) & every
        mh = (mh << 1) & every
        plus = mh | (every & ~(xv | ph))
        minus = ph & xv
    return score


def _beyond(plus: int, minus: int, j: int, n: int, m: int, limit: int) -> bool:
    """Whether all paths through a column of the distances of n rows to m columns, given by its steps up and down, cost over the limit."""
    low, high = max(0, j - limit), min(n, j + limit)
    below = (1 << low) - 1
    d = j + (plus & below).bit_count() - (minus & below).bit_count()
    plus, minus = plus >> low, minus >> low
    for i in range(low, high + 1):
        if d + abs(n - i - m + j) <= limit:
            return False
        d += (plus & 1) - (minus & 1)
        plus >>= 1
        minus >>= 1
    return True


def at_most(a: str, b: str, limit: float) -> float:
    """An upper bound of the edit distance: the cost of an alignment of words that steps over differences.

    Where words differ, it goes on at the nearest place, within what the limit allows, where two words in a row
    agree; what lies between counts with its own edit distance.  Stops, with what it has, once that is over the
    limit; gives up, with infinity, where it finds no such place.
    """
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    i = j = cost = 0
    pairs: dict[tuple[str, str], list[int]] = {}
    while i < n and j < m:
        if x[i] == y[j]:
            k = 1
            while x[i : i + 16] == y[j : j + 16] and i + 16 <= n and j + 16 <= m:
                i += 16
                j += 16
                k = 0
            i += k
            j += k
            continue
        for s, t in _STEPS:
            if x[i + s : i + s + 2] == y[j + t : j + t + 2]:
                break
        else:
            if not pairs:
                for k, p in enumerate(zip(y, y[1:])):
                    pairs.setdefault(p, []).append(k)
            s = t = int(limit) + 1  # a word is two bytes at least, with its blank
            for k, p in enumerate(zip(x[i : i + s], x[i + 1 : i + s + 1])):
                if k >= s + t:
                    break
                found = pairs.get(p, [])
                at = bisect_left(found, j)
                if at < len(found) and k + found[at] - j < s + t:
                    s, t = k, found[at] - j
            if s + t > 2 * limit:
                return float("inf")
        cost += edit_distance("".join([w + " " for w in x[i : i + s]]), "".join([w + " " for w in y[j : j + t]]))
        if cost > limit:
            return cost
        i += s
        j += t
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


#: Words to step over on either side, nearest first.
_STEPS = sorted(((s, t) for s in range(6) for t in range(6) if s or t), key=lambda p: (max(p), sum(p)))


def _trigrams(a: str) -> np.ndarray:
    c = np.frombuffer(a.encode("latin-1"), np.uint8).astype(np.int64)
    return np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) & 8191, minlength=8192)


def at_least(a: str, b: str) -> float:
    """A lower bound of the edit distance: an edit changes three trigrams at most; sharing a counter only lowers it."""
    if min(len(a), len(b)) < 3:
        return 0
    d = _trigrams(a) - _trigrams(b)
    return max(d[d > 0].sum(), -d[d < 0].sum()) / 3


def trigram_bits(lines: list[str]) -> np.ndarray:
    """Which trigrams each line has, as bits by hash, in words of 64."""
    longest = max(map(len, lines))
    n_bits = min(max(1 << (TRIGRAMS * longest - 1).bit_length(), TRIGRAM_BITS[0]), TRIGRAM_BITS[1])
    out = np.zeros((len(lines), n_bits // 8), np.uint8)
    size = np.array([len(x) for x in lines])
    k = 0
    while k < len(lines):  # bounds the bytes held at once
        m = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), 1 << 20, side="right")) + k)
        c = np.frombuffer("".join(lines[k:m]).encode("latin-1"), np.uint8).astype(np.uint32)
        line = np.repeat(np.arange(k, m), size[k:m])
        whole = line[2:] == line[:-2] if len(c) > 2 else np.zeros(0, bool)
        h = ((c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - n_bits.bit_length() + 1))[whole] if len(c) > 2 else np.zeros(0, np.uint32)
        np.bitwise_or.at(out, (line[2:][whole] if len(c) > 2 else line[:0], h >> 3), (1 << (h & 7)).astype(np.uint8))
        k = m
    return out.view(np.uint64)


def too_far(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = SIMILAR) -> np.ndarray:
    """Whether trigrams a, b of lines of n, m bytes rule similarity out: an edit takes three of a line's trigrams away at most, and brings three."""
    common = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    more = np.maximum(np.bitwise_count(a).sum(axis=-1, dtype=np.int64), np.bitwise_count(b).sum(axis=-1, dtype=np.int64))
    return more - common > 3 * ((100 - percent) * np.maximum(n, m) // 100)


def similar(a: str, b: str, percent: int = SIMILAR) -> bool:
    longer = max(len(a), len(b))
    least = (100 - percent) * longer / 100
    if abs(len(a) - len(b)) > least:
        return False
    if longer <= 128:
        return edit_distance(a, b, least) <= least
    if at_most(a, b, least) <= least:
        return True
    return at_least(a, b) <= least and edit_distance(a, b, least) <= least


def within(pairs: list[tuple[bytes, bytes]], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit, exactly; no pair may hold the bytes 0 or 1.

    Bit-parallel columns as in ``edit_distance``, of all pairs at once and only of the diagonals that a path within the limit
    can reach.  A pair leaves as soon as its cost so far, on the diagonal where it ends, is over the limit: it never falls.
    """
    out = np.zeros(len(pairs), bool)
    sides = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    n, m = (np.array([len(x) for x in side], np.int64) for side in zip(*sides))
    at = np.flatnonzero(n - m <= limits)
    if not len(at):
        return out
    n, m, limit = n[at], m[at], np.asarray(limits, np.int64)[at]
    score = n - m
    reach = (limit - score) // 2  # diagonals beyond those of the two ends
    words = int((2 * reach + score).max()) // 64 + 1
    rows, columns = 64 * words + int(n.max()), int(m.max())
    left = np.frombuffer(b"".join([(bytes(r) + sides[p][0]).ljust(rows, b"\0") for p, r in zip(at.tolist(), reach.tolist())]), np.uint8).reshape(len(at), rows)
    right = np.frombuffer(b"".join([sides[p][1].ljust(columns, b"\1") for p in at.tolist()]), np.uint8).reshape(len(at), columns)
    one, top = np.uint64(1), np.uint64(63)
    packed = lambda x: np.packbits(x, axis=1, bitorder="little").view(np.uint64).T
    # bit t of a column j is row j - reach + t; a row before the first has no step to the next
    plus = packed(np.arange(64 * words) >= reach[:, None])
    minus = np.zeros_like(plus)
    word, bit = (reach + score) // 64, ((reach + score) % 64).astype(np.uint64)
    for j in range(columns):
        if j and j % CHECKED == 0:
            open_ = score <= limit
            out[at[open_ & (m <= j)]] = True
            keep = np.flatnonzero(open_ & (m > j))
            if not len(keep):
                return out
            if len(keep) * 10 <= len(at) * 9:
                at, m, limit, score, word, bit, left, right = (x[keep] for x in (at, m, limit, score, word, bit, left, right))
                plus, minus = np.ascontiguousarray(plus[:, keep]), np.ascontiguousarray(minus[:, keep])
        same = packed(left[:, j : j + 64 * words] == right[:, j : j + 1])
        both = same & plus
        total = both + plus
        if words > 1:  # carries go on to the next word
            over = total < both
            for w in range(1, words):
                total[w] += over[w - 1]
                over[w] |= over[w - 1] & (total[w] == 0)
        equal = (total ^ plus) | same | minus
        own = equal[0] if words == 1 else equal[word, np.arange(len(at))]
        score += ((own >> bit & one) == 0) & (j < m)
        more, less = minus | ~(equal | plus), equal & plus
        down = equal >> one
        if words > 1:
            down[:-1] |= equal[1:] << top
        plus, minus = less | ~(down | more), down & more
    out[at[score <= limit]] = True
    return out


def similar_pairs(pairs: list[tuple[str, str]], percent: int = SIMILAR) -> np.ndarray:
    """``similar`` of many pairs: those of like lengths together, the longest and those that are few one by one."""
    out = np.zeros(len(pairs), bool)
    longer = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    limit = (100 - percent) * longer // 100
    order = np.argsort(longer, kind="stable")
    alone = order[int(np.searchsorted(longer[order], TOGETHER, side="right")) :].tolist()
    order = order[: len(order) - len(alone)]
    k = 0
    while k < len(order):
        most = min(max(int(longer[order[k]]) * 3 // 2, 128), TOGETHER)
        m = min(int(np.searchsorted(longer[order], most, side="right")), k + max(FEW, BATCH // most))
        part = order[k:m].tolist()
        k = m
        if len(part) < FEW:
            alone += part
        else:
            out[part] = within([(pairs[p][0].encode("latin-1"), pairs[p][1].encode("latin-1")) for p in part], limit[part])
    for p in alone:
        out[p] = similar(*pairs[p], percent)
    return out


def tell(told: list[np.ndarray], keys: np.ndarray, fresh: np.ndarray) -> None:
    """Takes those of ``fresh`` back whose keys are among ``told``, and adds the others; ``told`` holds sorted runs, each over twice as long as the next."""
    for run in told:
        at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
        fresh &= run[at] != keys
    made = np.sort(keys[fresh])
    if len(made):
        if sum(map(len, told)) >= TOLD:
            told.clear()  # starts afresh; lines may be told of again
        while told and len(told[-1]) <= 2 * len(made):
            made = np.sort(np.concatenate([told.pop(), made]), kind="stable")
        told.append(made)


def occurrences(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, line, key, simhash, n, blocks) of every line of which something is left; rid stands for doc_id and text, n for bytes.

    ``blocks`` is null where the task had the same line before.  One more row for each document has its number of
    lines as line, and no key.
    """

    def run(rids, ids, texts, told=[]):
        data, begin, end = normalised(texts)
        lines = [(t or "").count("\n") + 1 for t in texts]
        of = np.repeat(np.arange(len(texts)), lines)
        number = np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines)
        left = np.flatnonzero(end > begin)
        begin, end = begin[left], end[left]
        keys = np.fromiter(map(line_key, map(data.__getitem__, map(slice, begin.tolist(), end.tolist()))), np.int64, len(left))
        simhash, blocks, each = signatures(*line_words(data, begin))
        fresh = np.zeros(len(keys), bool)
        fresh[np.unique(keys, return_index=True)[1]] = True
        tell(told, keys, fresh)
        blocks = pa.ListArray.from_arrays(np.append(0, np.cumsum(each)).astype(np.int32), blocks.view(np.int64), mask=pa.array(~fresh))
        own = of[left]
        none = pa.nulls(len(texts))
        rid, doc = np.array(rids, np.int64), pa.array(ids, pa.int64())
        both = lambda a, b: pa.concat_arrays([pa.array(a), b if isinstance(b, pa.Array) else pa.array(b)])
        empty = lambda t: none.cast(t)
        return (
            both(rid[own], rid), pa.concat_arrays([doc.take(pa.array(own)), doc]),
            both(number[left].astype(np.int32), np.array([0 if t is None else n for t, n in zip(texts, lines)], np.int32)), both(keys, empty(pa.int64())),
            both(simhash.view(np.int64), empty(pa.int64())), both((end - begin).astype(np.int64), empty(pa.int64())), pa.concat_arrays([blocks, empty(blocks.type)]),
        )

    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, "rid long, doc_id long, line int, key long, simhash long, n long, blocks array<long>", run, "rid", "doc_id", "text")


def ruled_out(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = SIMILAR) -> np.ndarray:
    """Whether lengths n, m or SimHashes a, b (of long lines) rule similarity out."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (low * 100 < percent * high) | ((np.bitwise_count(a ^ b) > FAR) & (low >= 8 * SHORT))


def neighbours(blocks: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(center, key): lines (block, key, simhash, n) that share a block with another that isn't ruled out; the shortest is center."""
    schema = pa.schema([("center", pa.int64()), ("key", pa.int64())])

    def found(block: np.ndarray, key: np.ndarray, simhash: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((key, n, block))
        block, key = block[order], key[order]
        fresh = np.append(True, (block[1:] != block[:-1]) | (key[1:] != key[:-1]))  # tasks may tell of a line each
        order, block, key = order[fresh], block[fresh], key[fresh]
        simhash, n = simhash[order].view(np.uint64), n[order]
        group = np.cumsum(np.append(True, block[1:] != block[:-1])) - 1
        close = np.bincount(group)[group] > COMPARED
        alive = np.flatnonzero(~close)
        for lag in range(1, COMPARED):
            alive = alive[alive < len(key) - lag]
            alive = alive[group[alive] == group[alive + lag]]
            if not len(alive):
                break
            hit = alive[~ruled_out(simhash[alive], simhash[alive + lag], n[alive], n[alive + lag], percent)]
            close[hit] = close[hit + lag] = True
            alive = alive[n[alive] * 100 >= percent * n[alive + lag]]  # the rest of the group is longer still
        at = np.flatnonzero(close)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # within a group, a run of lengths that follow each other closely is a bucket
        first = np.append(True, (group[at[1:]] != group[at[:-1]]) | (n[at[:-1]] * 100 < percent * n[at[1:]]))
        return key[at[first]][np.cumsum(first) - 1], key[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if parts:
            made = found(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)
        trim()

    return blocks.repartition("block").mapInArrow(run, "center long, key long").distinct()


def meetings(lines: list[str]) -> list[np.ndarray]:
    """Groups of positions of lines that share a block, each group in order."""
    end = np.cumsum([len(x) + 1 for x in lines]) - 1
    _, blocks, each = signatures(*line_words("\n".join(lines).encode("latin-1"), np.append(0, end[:-1] + 1)))
    of = np.repeat(np.arange(len(lines)), each)
    order = np.lexsort((of, blocks))
    blocks, of = blocks[order], of[order]
    fresh = np.append(True, (blocks[1:] != blocks[:-1]) | (of[1:] != of[:-1]))
    blocks, of = blocks[fresh], of[fresh]
    return [g for g in np.split(of, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1) if len(g) > 1]


def verified(keys: list[int], contents: list[dict], percent: int = SIMILAR) -> list[tuple[int, int]]:
    """A forest of links between the lines of a bucket; see ``linking``."""
    return answered([linking(keys, contents, percent)], lambda pairs: similar_pairs(pairs, percent))[0]


def linking(keys: list[int], contents: list[dict], percent: int = SIMILAR) -> Generator[list[tuple[str, str]], np.ndarray, list[tuple[int, int]]]:
    """Yields pairs of lines of a bucket, is sent which are similar, and returns a forest of links; in larger buckets only lines that share a block are compared.

    Whether two lines link depends on them alone, not on what else is in the bucket: SimHashes, trigrams and words of both must
    not rule it out, and their edit similarity decides.  Only pairs that are connected already are left out.
    """
    order = sorted(range(len(keys)), key=lambda i: (len(contents[i]["line"]), keys[i]))
    lines = [contents[i]["line"] for i in order]
    value = np.array([contents[i]["simhash"] for i in order], np.int64).view(np.uint64)
    size = np.array([len(x) for x in lines])
    bits = trigram_bits(lines) if len(keys) > FEW_LINES else None  # of few lines all distances are computed
    groups = Groups(len(keys))
    label = groups.label
    words: list[frozenset | None] = [None] * len(keys)
    out: list[tuple[int, int]] = []

    def distinct(i: int) -> frozenset:
        if words[i] is None:
            words[i] = frozenset(lines[i].split(" "))
        return words[i]

    def worded(i: int, j: int) -> bool:
        if min(size[i], size[j]) < 8 * SHORT:
            return True
        a, b = distinct(i), distinct(j)
        return len(a & b) * 100 >= SAME * min(len(a), len(b)) - 100

    def compare(a: np.ndarray, b: np.ndarray):
        asked = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if worded(i, j)]
        if asked:
            yes = yield [(lines[i], lines[j]) for i, j in asked]
            for k in np.flatnonzero(yes).tolist():
                i, j = asked[k]
                if label[i] != label[j]:
                    out.append((order[i], order[j]))
                    groups.join(i, j)

    pairs, large = [], []
    for group in meetings(lines) if len(keys) > FEW_LINES else [np.arange(len(keys))]:
        if len(group) > COMPARED:
            large.append(group)
        else:
            a, b = two_of(len(group))
            pairs.append(group[a] * len(keys) + group[b])
    if pairs:  # the nearest first: most others are connected by then
        a, b = np.divmod(np.unique(np.concatenate(pairs)), len(keys))
        left = ~ruled_out(value[a], value[b], size[a], size[b], percent)
        a, b = a[left], b[left]
        if bits is not None:
            left = np.concatenate([~too_far(bits[x], bits[y], size[x], size[y], percent) for x, y in zip(_parts(a), _parts(b))])
            a, b = a[left], b[left]
        near = np.argsort(np.bitwise_count(value[a] ^ value[b]), kind="stable")
        step, rounds = 2 * len(keys), 0
        while len(near):
            near = near[label[a[near]] != label[b[near]]]
            first = np.ones(min(step, len(near)), bool)
            if rounds < TRUSTED:  # pairs that the nearer ones of this round will connect, if they are similar, can wait
                first[:] = connecting(label[a[near[:step]]].tolist(), label[b[near[:step]]].tolist())
            now = near[:step][first]
            yield from compare(a[now], b[now])
            near, step, rounds = np.concatenate([near[:step][~first], near[step:]]), min(2 * step, 4096), rounds + 1
    group = np.unique(np.concatenate(large)) if large else np.zeros(0, np.int64)  # once, as such groups are often much the same
    for k in range(1, len(group), AT_ONCE):
        waiting = []
        for p in range(k, min(k + AT_ONCE, len(group))):
            i, before = int(group[p]), group[:p]
            left = (label[before] != label[i]) & ~ruled_out(value[before], value[i], size[before], size[i], percent)
            near = before[left]
            waiting.append((i, near[np.argsort(np.bitwise_count(value[near] ^ value[i]), kind="stable")]))
        step = 1  # in a group of near copies the nearest settles it
        while waiting:
            left = [(i, near[label[near] != label[i]]) for i, near in waiting]
            part = [(i, near[:step]) for i, near in left]
            part = [(i, near[~too_far(bits[near], bits[i], size[near], size[i], percent)]) for i, near in part if len(near)]
            if part:
                yield from compare(np.repeat([i for i, _ in part], [len(near) for _, near in part]), np.concatenate([near for _, near in part]))
            waiting = [(i, near[step:]) for i, near in left if len(near) > step]
            step = min(8 * step, 512)
    return out


@lru_cache(32)
def two_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of 0 .. n-1."""
    return np.triu_indices(n, 1)


def connecting(a: list[int], b: list[int]) -> list[bool]:
    """Which links, in order, connect what those before them don't."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for x, y in zip(a, b):
        x, y = root(x), root(y)
        out.append(x != y)
        up[x] = y
    return out


def _parts(a: np.ndarray) -> list[np.ndarray]:
    """An array in parts: a short first one, then ones of bounded size."""
    return [a[:16], *(a[k : k + 4096] for k in range(16, len(a), 4096))]


def place_hashes(rids, lines) -> np.ndarray:
    """A hash of each (rid, line)."""
    return mixed(np.asarray(rids, np.int64).view(np.uint64) + np.asarray(lines, np.int64).view(np.uint64) * np.uint64(_ODD))


def line_groups(docs: DataFrame, lines: DataFrame, classes: DataFrame, n_classes: int, percent: int = SIMILAR) -> DataFrame:
    """(key, group) of linked line classes (key, at, simhash, n)."""
    spark = docs.sparkSession
    blocks = lines.where("blocks IS NOT NULL").select(F.explode("blocks").alias("block"), "key", "simhash", "n")
    pairs = checkpointed(neighbours(blocks, percent), n_classes)
    release(spark)
    for _ in range(2):  # buckets whose centers are neighbours become one, so that fewer lines travel twice
        least = pairs.groupBy("key").agg(F.min("center").alias("least")).withColumnRenamed("key", "center")
        pairs = pairs.join(least, "center").select(F.col("least").alias("center"), "key").distinct()
    members = checkpointed(pairs.join(classes, "key").select("center", "key", "n", "simhash", "at"), n_classes)
    n = members.count()
    release(spark)
    rows = checkpointed(buckets(members.select("center", "key", "n"), percent, 4_000_000), n)
    wanted = checkpointed(members.select("key", "simhash", F.col("at.rid").alias("rid"), F.col("at.line").alias("line")).distinct(), n)
    docs_marked = spark.sparkContext.broadcast(bitmap(wanted.select(F.col("rid").alias("h")), bits_for(n)))
    places = arrow_map(wanted, "h long", lambda r, l: (place_hashes(r, l).view(np.int64),), "rid", "line")
    lines_marked = spark.sparkContext.broadcast(bitmap(places, bits_for(n)))

    def maybe(rids, texts):
        yes = in_bitmap(docs_marked.value, np.array(rids, np.int64).view(np.uint64))
        at = [(r, i, line) for r, t, y in zip(rids, texts, yes) if y for i, line in enumerate((t or "").split("\n"))]
        if at:
            yes = in_bitmap(lines_marked.value, place_hashes([r for r, _, _ in at], [i for _, i, _ in at]))
            at = [x for x, y in zip(at, yes) if y]
        data, begin, end = normalised([line for _, _, line in at])
        kept = [data[a:b].decode("latin-1") for a, b in zip(begin.tolist(), end.tolist())] if at else []
        return [r for r, _, _ in at], [i for _, i, _ in at], kept

    texts = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text")
    texts = arrow_map(texts, "rid long, line int, text string", maybe, "rid", "text")
    texts = wanted.join(texts, ["rid", "line"]).dropDuplicates(["key"])
    content = texts.select("key", F.struct(F.col("text").alias("line"), "simhash").alias("content"))
    links = block_links(rows.join(content, "key"), lambda k, c: linking(k, c, percent), "content", lambda pairs: similar_pairs(pairs, percent))
    return connected_components(links, n).select(F.col("node").alias("key"), F.col("component").alias("group"))


def dropped_lines(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(rid, dropped): the line numbers, from 0 in order, that each document loses; only documents that lose some."""
    return dropped_of(docs, checkpointed(occurrences(docs)), percent)


def dropped_of(docs: DataFrame, lines: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The same from the occurrences of ``docs``."""
    lines = lines.where("key IS NOT NULL")
    at = F.struct("doc_id", "line", "rid")
    classes = lines.groupBy("key").agg(F.min(at).alias("at"), F.min("simhash").alias("simhash"), F.min("n").alias("n"), F.count("*").alias("times"))
    classes = checkpointed(classes, lines.count())
    groups = line_groups(docs, lines, classes, classes.count(), percent)
    grouped = groups.join(classes, "key").select("key", "group", "at")
    firsts = grouped.groupBy("group").agg(F.min("at").alias("first"))
    repeated = grouped.join(firsts, "group").select("key", "first").unionByName(
        classes.where("times > 1").join(groups, "key", "left_anti").select("key", F.col("at").alias("first"))
    )
    gone = lines.join(repeated, "key").where(~at.eqNullSafe(F.col("first")))
    return gone.groupBy("rid").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def dedup_lines(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """``docs`` with text without the dropped lines; n_lines and n_kept count lines before and after."""
    own = docs.drop("n_lines", "n_kept")
    marked = own.withColumn("__rid", F.xxhash64("doc_id", "text"))
    gone = dropped_lines(docs, percent).withColumnRenamed("rid", "__rid").withColumnRenamed("dropped", "__dropped")
    rows = marked.join(gone, "__rid", "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__dropped", i)), "\n")
    before = F.coalesce(F.size(lines), F.lit(0))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(before).cast("int"))
    rows = rows.withColumn("n_kept", (F.col("n_lines") - F.coalesce(F.size("__dropped"), F.lit(0))).cast("int"))
    rows = rows.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(kept))
    return rows.select(*own.columns, "n_lines", "n_kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before and after, and the numbers of those dropped."""
    docs = documents(spark, sf_dir)
    lines = checkpointed(occurrences(docs))
    rows = lines.where("key IS NULL").select("doc_id", "rid", F.col("line").alias("n_lines"))
    rows = rows.join(dropped_of(docs, lines), "rid", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")
