"""Exact Jaccard self-join of word-shingle sets by prefix trees.

1. Each document becomes a sorted set of 64-bit shingle hashes.  Equal sets are one class.
2. All sets take one global order: shingles marked frequent last, else by hash.  Two sets with
   Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of each, so these meet by
   shingle.  The marks come from counts over all documents, kept in a bitmap of fixed size; they
   only choose the order, and any order gives the same links.
3. Those that meet at a shingle are cut into runs of compatible sizes, and a run belongs to the
   bucket of its smallest set.  A pair that may link shares at least one bucket.
4. A bucket stores its sets in a prefix tree, most common shingles first.  All sets walk the tree
   together, sharing the partial overlaps of a branch, and a set leaves a branch when its size, the shingles
   that remain, or an existing connection show that nothing there can add a link.
   Buckets are cut into blocks of bounded size that meet pair by pair, sizes permitting.
5. Links, as a forest per block, give the connected components.

Sets only travel for classes that share a bucket.  Classes are told apart by 64-bit hashes of their sets, and
shingles by 64-bit hashes of their words: up to collisions of these the join is exact.  Null texts and texts
without words are empty sets, linked with nothing.  Repeated rows stay; they share their class.  Rows without
a doc_id link as others do, also as the bridge between two documents, but give a group no name: a group
of such rows alone has a null component_id.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import block_links, buckets
from tessera.llm.common import arrow_map, checkpointed, connected_components, documents, release
from tessera.llm.shingles import bitmap, bits_for, in_bitmap, set_key, shingle_set

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A shingle that this many prefixes hold is marked frequent.
FREQUENT = 3


def prefix_length(n, percent: int = PERCENT):
    return n - (-(-n * percent // 100)) + 1


def needed(a, b, percent: int = PERCENT):
    """Smallest intersection of linked sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix(s: np.ndarray, frequent: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    n = prefix_length(len(s), percent)
    if frequent is None:
        return s[:n]
    often = in_bitmap(frequent, s)
    rare = s[~often]
    return rare[:n] if len(rare) >= n else np.concatenate([rare, s[often][: n - len(rare)]])


class PrefixTree:
    """Path-compressed tree of ordered sets; ``links()`` joins them with themselves."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.size = np.array([len(s) for s in sets])
        values, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(values))
        self.distinct = int((often > 1).sum())  # the rest is in one set only and never overlaps
        at = np.concatenate([[0], np.cumsum(self.size)])
        ranks = rank[where]
        own = [np.sort(ranks[a:b]) for a, b in zip(at, at[1:])]
        self.sets = [s[: np.searchsorted(s, self.distinct)] for s in own]
        keys = [s.astype(">u4").tobytes() for s in self.sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self._build()

    def _build(self) -> None:
        """Nodes as (begin, end, low, high, children): shingles [begin, end) of the leaves [low, high)."""
        leaves = [self.sets[i] for i in self.order]
        n = len(leaves)
        shared = np.zeros(n, np.int64)  # with the leaf before
        for k in range(1, n):
            a, b = leaves[k - 1], leaves[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = differ[0] if len(differ) else m
        size = self.size[self.order]
        length = np.array([len(s) for s in leaves])
        self.leaves, self.leaf_size = leaves, size
        self.nodes: list[tuple] = []
        waiting = [(0, n, 0, None)]
        while waiting:
            low, high, begin, above = waiting.pop()
            end = len(leaves[low]) if high - low == 1 else int(shared[low + 1 : high].min())
            children: list[int] = []
            part = slice(low, high)
            self.nodes.append((begin, end, low, high, children, int(size[part].min()), int(size[part].max()), int(length[part].max())))
            if above is not None:
                above.append(len(self.nodes) - 1)
            if high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] == end)).tolist(), high]
                waiting += [(a, b, end, children) for a, b in zip(cuts, cuts[1:])]

    def links(self) -> list[tuple[int, int]]:
        """A forest of links, as positions in ``sets``, that connects what all links connect.

        The tree is walked once by all sets together: at a node, those still in question and their overlaps so far are
        arrays, and sets leave where even the shingles that remain can't add a link, or where all is connected already.
        """
        n, percent = len(self.leaves), self.percent
        groups = Groups(n)
        label = groups.label
        out: list[tuple[int, int]] = []
        at = np.concatenate([[0], np.cumsum([len(s) for s in self.leaves])])
        whole = np.concatenate([*self.leaves, np.zeros(0, np.int64)])
        order = np.argsort(whole, kind="stable")  # leaves by shingle
        holders = np.searchsorted(at, order, side="right") - 1
        first = np.searchsorted(whole[order], np.arange(self.distinct + 1))
        size = self.leaf_size
        count = np.zeros(n, np.int32)
        waiting = [(0, np.arange(n), np.zeros(n, np.int32))]
        while waiting and groups.number > 1:
            node, sets, overlap = waiting.pop()
            begin, end, low, high, children, least, most, longest = self.nodes[node]
            keep = (sets < high - 1) | (not children)  # a pair is met at the leaf of its later set
            keep &= (most * 100 >= percent * size[sets]) & (size[sets] * 100 >= percent * least)
            if low + 1 == high or groups.uniform(low, high):
                keep &= label[sets] != label[low]
            sets, overlap = sets[keep], overlap[keep]
            if not len(sets):
                continue
            if end > begin:
                hold = [holders[first[v] : first[v + 1]] for v in self.leaves[low][begin:end].tolist()]
                for h in hold:
                    count[h] += 1
                overlap = overlap + count[sets]
                for h in hold:
                    count[h] = 0
            if children:
                keep = overlap + (longest - end) >= needed(size[sets], np.maximum(least, -(-size[sets] * percent // 100)), percent)
                sets, overlap = sets[keep], overlap[keep]
                waiting += [(c, sets, overlap) for c in reversed(children)]
            else:
                found = sets[(sets < low) & (overlap >= needed(size[sets], size[low], percent))]
                for i in found[np.unique(label[found], return_index=True)[1]].tolist():
                    out.append((self.order[i], self.order[low]))
                    groups.join(i, low)
        return out


class Groups:
    """Connected groups of 0 .. n-1 as labels that always hold; the smaller group takes the larger one's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}
        self.number = n

    def join(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return
        x, y = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(x) < len(y):
            a, b, x, y = b, a, y, x
        self.label[y] = a
        x += y
        self.members[a] = x
        self.number -= 1

    def uniform(self, low: int, high: int) -> bool:
        """Whether low .. high-1 are one group; a look at the ends settles most cases."""
        return self.label[low] == self.label[high - 1] and bool((self.label[low:high] == self.label[low]).all())


def sets_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, rid, n, key and the prefix of every document's set in the order by hash alone; rid stands for doc_id and text."""

    def run(ids, hashes, texts):
        sets = [shingle_set(t) for t in texts]
        firsts = [prefix(s, None, percent).view(np.int64) if prefix_usable(len(s), percent) else [] for s in sets]
        return ids, hashes, [len(s) for s in sets], [set_key(s) for s in sets], firsts

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    return arrow_map(rows, "doc_id long, rid long, n long, key long, first array<long>", run, "doc_id", "rid", "text")


def prefix_usable(n: int, percent: int) -> bool:
    """Whether a set of this size can link with a different one."""
    return n > 0 and (n * 100 >= percent * (n + 1))


def meetings(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(center, key, n): the buckets of every class that shares a prefix shingle with one of compatible size."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(texts):
        sets = [shingle_set(t) for t in texts]
        firsts = [prefix(s, sent.value, percent).view(np.int64) if prefix_usable(len(s), percent) else [] for s in sets]
        return [len(s) for s in sets], [set_key(s) for s in sets], firsts

    rows = arrow_map(docs, "n long, key long, first array<long>", run, "text").select("n", "key", F.explode("first").alias("shingle"))
    by = Window.partitionBy("shingle").orderBy("n", "key")
    fresh = F.coalesce(F.lag("n").over(by) * 100 < F.col("n") * percent, F.lit(True))
    runs = rows.withColumn("fresh", fresh.cast("int")).withColumn("key_before", F.lag("key").over(by))
    runs = runs.where("fresh = 1 OR key <> key_before")  # copies stand side by side
    runs = runs.withColumn("center", F.last(F.when(F.col("fresh") == 1, F.col("key")), ignorenulls=True).over(by))
    pairs = runs.where("center <> key").select("center", "key", "n").distinct()
    return pairs


def tree_links(sets: list[bytes], percent: int = PERCENT) -> list[tuple[int, int]]:
    return PrefixTree([np.frombuffer(s, np.uint64) for s in sets], percent).links()


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, rid, group, n_shingles, component_id for every row of ``docs``; rid stands for doc_id and text, rows of one group are linked unless they have no shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    own = checkpointed(sets_of(docs, percent))
    n, shingles = own.agg(F.count("*"), F.sum(F.size("first"))).first()
    often = own.select(F.explode("first").alias("h")).groupBy("h").count().where(F.col("count") >= FREQUENT)
    frequent = bitmap(often.select("h"), bits_for((shingles or 0) // 64))  # far fewer are frequent
    often = None
    release(spark)
    pairs = checkpointed(meetings(docs, frequent, percent), n)
    release(spark)
    n = pairs.count()
    classes = own.where("n > 0").groupBy("key", "n").agg(F.min("rid").alias("rid"))  # any row of the class has its set
    centers = pairs.select(F.col("center").alias("key")).distinct().join(classes.select("key", "n").dropDuplicates(["key"]), "key")
    whole = pairs.unionByName(centers.withColumn("center", F.col("key")))
    # a whole bucket, with its center, joins one that its center is in, so that few sets travel twice
    least = pairs.groupBy(F.col("key").alias("center")).agg(F.min("center").alias("into"))
    members = whole.join(least, "center", "left").select(F.coalesce("into", "center").alias("center"), "key", "n").distinct()
    rows = checkpointed(buckets(members, percent), n)
    wanted = checkpointed(rows.select("key").distinct().join(classes, "key").select("key", "rid"), n)
    marked = spark.sparkContext.broadcast(bitmap(wanted.select(F.col("rid").alias("h")), bits_for(n)))

    def maybe(hashes, texts):
        yes = in_bitmap(marked.value, np.array(hashes, np.int64).view(np.uint64))
        sets = [shingle_set(t) for t, y in zip(texts, yes) if y]
        return [set_key(s) for s in sets], [s.tobytes() for s in sets]

    sets = arrow_map(docs.select(F.xxhash64("doc_id", "text").alias("h"), "text"), "key long, shingles binary", maybe, "h", "text")
    sets = sets.dropDuplicates(["key"]).select("key", "shingles")  # few others pass the bitmap; the join drops them
    links = block_links(rows.join(sets, "key"), lambda _, s: tree_links(s, percent), "shingles")
    parts = connected_components(links, n).select(F.col("node").alias("key"), "component")
    rows = own.select("doc_id", "rid", F.col("n").alias("n_shingles"), "key").join(parts, "key", "left")
    rows = rows.withColumn("group", F.coalesce("component", "key"))
    least = rows.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "group", "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "rid", "group", "n_shingles", linked.alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return jaccard_groups(docs, percent).select("doc_id", "n_shingles", "component_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
