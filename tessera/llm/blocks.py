"""Buckets of members that must meet, cut into blocks of bounded size, and a forest of links for each."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units of size in a block.
BLOCK = 2_000_000
#: Members of block pairs whose questions are asked together.
HELD = 8000


def buckets(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(key, center, a, b): the pairs of blocks of each bucket in which a member takes part.

    ``members`` has center, key and n.  A block holds members of about ``block`` units of n, by size,
    and meets itself and every block whose sizes are within ``percent`` of each other.
    """
    by = Window.partitionBy("center").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, 0)
    members = members.withColumn("block", F.floor((F.sum("n").over(by) - F.col("n")) / block).cast("int"))
    ranges = members.groupBy("center", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a = ranges.select("center", F.col("block").alias("a"), F.col("most").alias("a_most"))
    b = ranges.select("center", F.col("block").alias("b"), F.col("least").alias("b_least"))
    near = (F.col("a") < F.col("b")) & (F.col("a_most") * 100 >= F.col("b_least") * percent)
    meet = a.join(b, "center").where((F.col("a") == F.col("b")) | near)
    sides = meet.select("center", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return members.join(sides, ["center", "block"]).select("key", "center", "a", "b")


def stars(forest: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same groups with every node linked to its group's least."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in forest:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up) if root(x) != x]


def answered(asking: list[Generator], ask: Callable[[list], Sequence]) -> list:
    """What generators return that yield lists of questions and are sent the answers; those of all are asked together, round by round."""
    out = [None] * len(asking)
    sent: list[tuple[int, Sequence | None]] = [(i, None) for i in range(len(asking))]
    while sent:
        asked = []
        for i, answer in sent:
            try:
                asked.append((i, asking[i].send(answer)))
            except StopIteration as e:
                out[i] = e.value
        answers = ask([q for _, questions in asked for q in questions]) if asked else []
        sent, at = [], 0
        for i, questions in asked:
            sent.append((i, answers[at : at + len(questions)]))
            at += len(questions)
    return out


def block_links(rows: DataFrame, link: Callable[[list, list], list[tuple[int, int]] | Generator], content: str, ask: Callable[[list], Sequence] | None = None) -> DataFrame:
    """(src, dst) from (center, a, b, key, content): ``link(keys, contents)`` gives each block pair's forest, as positions; it comes out as stars.

    With ``ask``, ``link`` is a generator as in ``answered``, and block pairs of about ``HELD`` members are settled together.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, contents, links = None, [], [], []
        held: list[tuple[list, Generator]] = []
        members = 0

        def add(keys: list, forest: list[tuple[int, int]]) -> None:
            links.extend(stars([(keys[i], keys[j]) for i, j in forest]))

        def settle() -> None:
            nonlocal members
            members = 0
            if ask is not None:
                for (keys, _), forest in zip(held, answered([x for _, x in held], ask)):
                    add(keys, forest)
                held.clear()

        def done() -> None:
            nonlocal members
            if len(keys) > 1 and ask is None:
                add(keys, link(keys, contents))
            elif len(keys) > 1:
                held.append((keys, link(keys, contents)))
                members += len(keys)
                if members >= HELD:
                    settle()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *group, key, c in zip(*columns):
                if group != at:
                    done()
                    at, keys, contents = group, [], []
                keys.append(key)
                contents.append(c)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)
                links.clear()
        done()
        settle()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)

    rows = rows.repartition("center", "a", "b").sortWithinPartitions("center", "a", "b", "key")
    return rows.select("center", "a", "b", "key", content).mapInArrow(run, "src long, dst long")
