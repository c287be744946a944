"""What the text operators share: reading, checkpoints, connected components, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["arrow_map", "checkpoint_folder", "checkpointed", "connected_components", "documents", "release", "slices", "table", "trim"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns ``cols`` of a table, or all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(cols or ("doc_id", "text")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without that setting (as in tests) gets one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of a small table that one checkpoint file holds.
FILE_ROWS = 100_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once into the shared folder, so that lost executors cost no rerun.

    ``rows``, where it is known how many there are about, keeps small tables from being cut into a file for every
    shuffle partition: they are dealt to fewer tasks after the work, which keeps its own.
    """
    checkpoint_folder(df.sparkSession)
    if rows is not None:
        files = rows // FILE_ROWS + 8
        if files * 4 < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to, now that a checkpoint replaced them.

    It does so only when the driver collects garbage, which may otherwise be long after the disk is full.
    Python's references are given up by a thread that wakes every second, hence the wait.
    """
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes of an Arrow batch that are held as Python objects at once.
ROWS, BYTES = 512, 4 << 20


def slices(batch: pa.RecordBatch, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch within ``ROWS`` rows and about ``most`` bytes, or of a single row."""
    waiting = [(0, batch.num_rows)]
    while waiting:
        at, n = waiting.pop()
        part = batch.slice(at, n)
        if n > 1 and (n > ROWS or part.nbytes > most):
            waiting += [(at + n // 2, n - n // 2), (at, n // 2)]
        elif n:
            yield part


def trim() -> None:
    """Gives free memory of a worker back, which other tasks of the executor may need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, schema: str, fn: Callable[..., tuple], *cols: str) -> DataFrame:
    """``fn(*column lists) -> lists`` over Arrow batches of the columns ``cols``; rows go out as ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                made = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(made, out)], schema=out)
        trim()

    return df.select(*cols).mapInArrow(run, schema)


def connected_components(edges: DataFrame, rows: int | None = None, rounds: int = 50) -> DataFrame:
    """(node, component) of an undirected edge table (src, dst); component is the smallest node reached.

    Alternating large-star and small-star steps: each round is a few shuffles of the edges, and the
    edges become stars in about log(longest path) rounds.  Each star is made from a minimum that is
    aggregated before the shuffle.  Where it is joined back, a hub's edges, two numbers each, pass through one task in
    sorted order, or through several once Spark's adaptive skew join finds the partition too large.
    Nodes without an edge to another node are left out.  Nulls never link.  ``rows``: about how many edges
    there are, if that is known.
    """
    e = (
        edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .where("a > b")  # also drops nulls and self-links
        .distinct()
    )
    spark = e.sparkSession
    e = checkpointed(e, rows)
    release(spark)
    state = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = e.agg(*state).first()
    for _ in range(rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))
            .where("a > b")
            .distinct()
        )
        e = checkpointed(small, before[0])
        now = e.agg(*state).first()
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
