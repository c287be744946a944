"""Placement of rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (an offset and a stride
from its name's hash).  Shards take turns; each claims the first slot of its order that is still free.
So shares differ by one slot at most, and adding or removing a shard moves few slots.  A row's key
hashes to a slot, and the broadcast table gives the slot's shard in constant time, without a shuffle.

The table depends on the shards' names and its size alone and is checked against ``LARGEST`` before
it is broadcast.  A key that holds a large share of the rows would fill one shard; ``spread`` names
columns that are hashed along with such keys (those over ``hot_share`` of all rows), so that their
rows scatter.  Null keys hash as the empty string.  Equal rows go to the same shard.  Columns of the
input stay; ``slot`` and ``shard`` replace columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

SHARDS = 64
SLOTS = 65537
LARGEST = 1 << 20


def preferences(name: str, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's order of slots."""
    d = hashlib.md5(name.encode()).digest()
    return int.from_bytes(d[:7], "big") % slots, int.from_bytes(d[7:14], "big") % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """By slot, the index of the shard that claimed it."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if slots < len(names) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime and not below that of shards")
    orders = [preferences(n, slots) for n in names]
    at = [o for o, _ in orders]
    owner = [-1] * slots
    taken = 0
    while True:
        for i, (_, stride) in enumerate(orders):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + stride) % slots
            owner[at[i]] = i
            taken += 1
            if taken == slots:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def lookup_table(spark: SparkSession, names: list[str], slots: int) -> DataFrame:
    """(slot, shard), ``slots`` rows."""
    if slots > LARGEST:
        raise ValueError(f"a table of {slots} slots is too large to broadcast")
    owners = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(
    df: DataFrame, key: str, names: list[str], slots: int = SLOTS, spread: list[str] = (), hot_share: float | None = None
) -> DataFrame:
    """``df`` with slot and shard (the index in ``names``)."""
    df = df.drop("slot", "shard")
    hashed = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if spread:
        share = 1 / len(names) if hot_share is None else hot_share
        sizes = df.groupBy(hashed.alias("__key")).agg(F.count("*").alias("__n"))
        hot = sizes.where(F.col("__n") > share * F.lit(df.count()))  # fewer than 1 / share keys
        found = {r[0] for r in hot.select("__key").collect()}
        if found:
            rest = F.concat_ws("\x1f", hashed, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spread))
            hashed = F.when(hashed.isin(*found), rest).otherwise(hashed)
    placed = df.withColumn("slot", slot_of(hashed, slots))
    return placed.join(F.broadcast(lookup_table(df.sparkSession, names, slots)), "slot").select(*df.columns, "slot", "shard")


def op1_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by doc_id, with the size of its text."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)])
