"""A change log as a table of epochs, and file ingest that goes through one.

Each epoch's rows are a partition that is overwritten as a whole, so that an epoch which is delivered again after a
failure replaces itself.  Readers see the log, or its latest rows by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import mine, not_mined, scan_files

EPOCH = "epoch"


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """``rows`` as the whole of an epoch of the log."""
    rows.withColumn(EPOCH, F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(EPOCH).parquet(path)


def log_sink(path: str, change: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch as its epoch; a replayed batch ends in the same table."""

    def run(batch: DataFrame, epoch: int) -> None:
        rows = change(batch)
        if not rows.isEmpty():
            write_epoch(rows, path, epoch)

    return run


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all epochs; an empty log where nothing was written yet."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    whole = f"{schema}, {EPOCH} long"
    try:
        return spark.read.schema(whole).parquet(path)
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], whole)


def latest(log: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each key's last epoch: an epoch takes the place of all the key had before."""
    last = log.groupBy(*key).agg(F.max(EPOCH).alias("__last"))
    same = [log[k].eqNullSafe(last[k]) for k in key]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return log.join(last, cond & (log[EPOCH] == last["__last"]), "left_semi").drop(EPOCH)


#: Rows of the ingest log: a file's chunks, or one row without an id for a file that has none any more.
CHUNK = "id string, text string, source_file string, chunk_index int, added_by string, content_type string, filed_at string, mtime timestamp"


def ingest_changes(spark: SparkSession, root: str, log: str, agent: str, filed_at: str, **scan) -> int:
    """Takes in the files below ``root`` that are new, changed or gone since the log's last epoch; the number of the epoch written, or of the last one.

    A file's chunks of a new epoch replace those it had.  All that happens is one write of one epoch: a run that fails before it
    leaves the log as it was, and is done anew.  ``scan`` goes to ``scan_files``.
    """
    known = read_log(spark, log, CHUNK)
    epoch = known.agg(F.max(EPOCH)).first()[0]
    now = latest(known, ["source_file"])
    manifest = now.groupBy("source_file").agg(F.max("mtime").alias("mtime"), F.max("id").alias("id"))
    files = scan_files(spark, root, **scan)
    fresh = not_mined(files, manifest.where("id IS NOT NULL OR mtime IS NOT NULL"))
    stamp = fresh.select(F.col("rel").alias("source_file"), F.col("modified").alias("mtime"))
    made = stamp.join(mine(fresh, agent, filed_at), "source_file", "left")  # a file without a chunk has a row that says so
    gone = manifest.where("mtime IS NOT NULL").join(files.select(F.col("rel").alias("source_file")), "source_file", "left_anti").select("source_file")
    names = [c.split()[0] for c in CHUNK.split(", ")]
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CHUNK.split(", ") if c.split()[0] != "source_file"]
    rows = made.select(*names).unionByName(gone.select("source_file", *none).select(*names))
    if rows.isEmpty():
        return -1 if epoch is None else epoch
    write_epoch(rows, log, (-1 if epoch is None else epoch) + 1)
    return (-1 if epoch is None else epoch) + 1


def ingested(spark: SparkSession, log: str) -> DataFrame:
    """The chunks of all files as they are now."""
    return latest(read_log(spark, log, CHUNK), ["source_file"]).where("id IS NOT NULL")


def ingest_stream(spark: SparkSession, root: str, log: str, agent: str, filed_at: str, checkpoint: str) -> None:
    """Takes in new files below ``root`` as a file stream, once through what there is; a batch is an epoch of the log, and a replayed one replaces itself."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")

    def change(batch: DataFrame) -> DataFrame:
        files = batch.withColumn("rel", F.substr("path", F.instr("path", base) + len(base) + 1)).withColumn("modified", F.col("modificationTime"))
        made = mine(files.select("rel", "content"), agent, filed_at)
        stamp = files.select(F.col("rel").alias("source_file"), F.col("modified").alias("mtime"))
        return stamp.join(made, "source_file", "left").select(*(c.split()[0] for c in CHUNK.split(", ")))

    q = stream.writeStream.foreachBatch(log_sink(log, change)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
