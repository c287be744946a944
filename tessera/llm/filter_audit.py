"""How five quality filters interact, over every order in which they could be applied.

A document removed at some step of an order is removed there because of the filters before that step as a set, not
because of their order.  So 5 * 2**4 = 80 lattice edges (set already applied, next filter) hold all there is to know
about the 120 * 5 = 600 steps of all orders: an order is a path through the lattice from the empty set to the full
one, and each of its steps is one edge.

1. Each document becomes the set of filters it fails (five bits), its part and its labels; texts are read once.
2. Documents are counted by these before anything is expanded, at most 128 rows for each part.
3. The counts contribute to the 80 edges, which are summed, and the 600 steps look their edge up.

A set of size s comes before a filter in s! (4 - s)! orders, so a filter's removals summed over all orders follow
from its 16 edges.

Null texts are empty.  A row fails E if its text is that of a row with a smaller doc_id; a row without a doc_id has
none smaller and is none.  Rows that repeat a doc_id count one by one; their labels are those of the id, good or toxic
if any of its label rows says so.  Rows without a lang are the part of the empty string.  An empty table gives no
rows.  Other columns are ignored.  Texts are compared by SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, documents, table

FILTERS = "ABCDE"
#: Failing a filter: fewer words than this; fewer distinct words than percent of all; more capitals than percent; any of these signs.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
ALL = (1 << len(FILTERS)) - 1


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.split(text, BLANKS)
    blank = F.array_contains(words, "").cast("int")
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    distinct = F.size(F.array_distinct(words)) - blank
    failed = (
        n < LEAST_WORDS,
        distinct * 100 < n * DISTINCT_PERCENT,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        text.rlike(SIGNS),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and fails, the bits of all five filters, for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    rows = checkpointed(rows)
    named = rows.where("doc_id IS NOT NULL")
    # the first of each text by id, then texts by id: both combine before they are dealt, and no key holds a whole group of copies
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("digest").alias("first"))
    copy = ~F.array_contains(F.coalesce("first", F.array().cast("array<binary>")), F.col("digest"))
    found = named.join(first, "doc_id", "left").select("doc_id", "part", (F.col("own") + copy.cast("int") * 16).alias("fails"))
    return found.unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", F.col("own").alias("fails")))


def fail_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, good, toxic and n, the number of documents."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = failed.where("doc_id IS NOT NULL").join(said, "doc_id", "left")
    nameless = failed.where("doc_id IS NULL").withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False))
    no = F.lit(False)
    rows = named.unionByName(nameless).select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return rows.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))


def lattice_edges(counts: DataFrame) -> DataFrame:
    """The 80 edges of each part: applied (bits), filter (0 to 4), and the counts of documents at that edge."""
    e = F.col("edge")
    rows = counts.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(5 * 16 - 1))))
    rows = rows.withColumn("filter", F.floor(e / 16).cast("int")).withColumn("rest", e % 16)
    low = F.expr("shiftleft(1, filter) - 1")
    rows = rows.withColumn("bit", F.expr("shiftleft(1, filter)"))
    rows = rows.withColumn("applied", F.col("rest").bitwiseAND(low) + F.expr("shiftleft(shiftright(rest, filter), filter + 1)"))
    fails, n = F.col("fails"), F.col("n")
    gone = fails.bitwiseAND(F.col("applied")) != 0
    hit = fails.bitwiseAND(F.col("bit")) != 0
    some = lambda c: F.sum(F.when(c, n).otherwise(F.lit(0)))
    return rows.groupBy("part", "applied", "filter").agg(
        some(~gone & ~hit).alias("kept"), some(~gone & hit).alias("removed"), some(gone & hit).alias("redundant"), some(fails == F.col("bit")).alias("unique_fails"),
        some(~gone & hit & F.col("good")).alias("good_lost"), some(~gone & hit & F.col("toxic")).alias("toxic_lost"),
    )


def paths() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, filter) of the 600 steps."""
    out = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, applied, f))
            applied |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, 600 rows for each part."""
    edges = lattice_edges(fail_counts(failures(docs), labels))
    size = F.bit_count("applied")
    ways = F.element_at(F.array(*(F.lit(factorial(s) * factorial(4 - s)) for s in range(5))), size + 1)
    summed = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = docs.sparkSession.createDataFrame(paths(), "filter_order string, step int, applied int, filter int")
    out = edges.join(summed, ["part", "filter"]).join(F.broadcast(steps), ["applied", "filter"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
