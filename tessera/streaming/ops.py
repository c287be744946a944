"""Structured Streaming forms of the stateful operators, each with a batch twin over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAVE_EVERY = 15
CUE_TTL = "300 seconds"


def available_now(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is into the memory table ``name``."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def human_messages(messages: DataFrame) -> DataFrame:
    """Messages that count: of the user, and no command."""
    return messages.where((F.col("role") == "user") & ~F.ltrim("text").rlike("^(/|<command)"))


def count_trigger_batch(messages: DataFrame, every: int = SAVE_EVERY) -> DataFrame:
    """(session, nth, ts): every ``every``-th message of a session fires."""
    w = Window.partitionBy("session").orderBy("ts", "id")
    r = messages.withColumn("nth", F.row_number().over(w))
    return r.where(F.col("nth") % every == 0).select("session", F.col("nth").cast("long").alias("nth"), "ts")


def count_trigger(messages: DataFrame, every: int = SAVE_EVERY) -> DataFrame:
    """Streaming: a counter per session, in order of arrival within a batch by ts and id."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        at = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        hit = [(key[0], k, ts) for k, ts in zip(at, rows["ts"]) if k % every == 0]
        yield pd.DataFrame(hit, columns=["session", "nth", "ts"])

    kind = dict(messages.dtypes)["session"]
    return messages.groupBy("session").applyInPandasWithState(step, f"session {kind}, nth long, ts timestamp", "n long", "append", GroupStateTimeout.NoTimeout)


def prune_expired(cues: DataFrame, now: str, ttl: str = CUE_TTL) -> DataFrame:
    """Cues within their time to live; those without a readable time stay."""
    return cues.where(F.col("cue_ts").isNull() | (F.col("cue_ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {ttl}")))


def latest_by_key(rows: DataFrame, key: list[str], value: str, ts: str) -> DataFrame:
    """The last value of each key; as a stream in complete or update mode."""
    return rows.groupBy(*key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def keyword_counts(observed: DataFrame) -> DataFrame:
    """Running frequency of keywords; as a stream in complete mode."""
    return observed.groupBy("keyword").agg(F.count("*").alias("freq"))


def once(evidence: DataFrame, key: list[str], ts: str, within: str = "1 hour") -> DataFrame:
    """Streaming: each key once within a watermark."""
    return evidence.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def tumbling_reuse(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Calls and reuse by day; a stream needs a watermark on ts."""
    g = log.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"), F.round(F.avg(F.col("reused").cast("double")), 4).alias("reuse_rate"))
    return g.select(F.col("w.start").alias("start"), "calls", "reuse_rate")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: session windows by a gap."""
    g = log.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def upsert_each_batch(write: Callable[[DataFrame, int], None], ready: Callable[[DataFrame], bool] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch once, if it isn't empty and ``ready`` says so."""

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty() and (ready is None or ready(batch)):
            write(batch, epoch)

    return run


def enough_pending(least: int = 5) -> Callable[[DataFrame], bool]:
    """Threshold dispatch: at least so many rows are pending."""
    return lambda batch: batch.limit(least).count() >= least


def error_ring(errors: DataFrame, keep: int = 200) -> DataFrame:
    """The last ``keep`` lines."""
    return errors.orderBy(F.desc("ts"), F.desc("id")).limit(keep)
