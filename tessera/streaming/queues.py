"""Queues of a session that calls consume from: cues with a time to live, and messages that wait to be declared.

Each has one rule, taken by a fold over tables and by a stateful processor over streams.  Streams take rows in order
within a batch, and batches as they arrive; their state is in the stream's checkpoint, so a restart goes on where it
was.  They need the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.folds import keyed_fold

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Fixed value: seconds that a cue may wait.
CUE_TTL = 300

CUE_EVENT = "session string, is_call boolean, tool string, id long, at long"
CUE_RESULT = "session string, tool string, call_id long, cue_id long, call_at long, cue_at long, n_expired int"
MESSAGE_EVENT = "session string, pos long, action string, id string, text string"
MESSAGE_RESULT = "session string, id string, text string, turn_idx long, appended_pos long, left_pos long"


def _row_of(schema: str) -> Row:
    return Row(*(c.split()[0] for c in schema.split(", ")))


# ---- cues ----


def cue_events(calls: DataFrame, cues: DataFrame) -> DataFrame:
    """Calls (session, tool, call_id, call_ts) and cues (session, tool, cue_id, cue_ts) as one table or stream of events."""
    a = calls.select(F.col("session").cast("string").alias("session"), F.lit(True).alias("is_call"), "tool", F.col("call_id").cast("long").alias("id"), F.unix_micros(F.col("call_ts").cast("timestamp")).alias("at"))
    b = cues.select(F.col("session").cast("string").alias("session"), F.lit(False).alias("is_call"), "tool", F.col("cue_id").cast("long").alias("id"), F.unix_micros(F.col("cue_ts").cast("timestamp")).alias("at"))
    return a.unionByName(b)


class CueFold:
    """Cues that are live, in order of arrival; a call takes the first of its tool, after those past their time are gone.

    Holds the cues of a session that no call has taken or outlived.  A cue without a time is always live; a call without one lets none expire.
    """

    def __init__(self, ttl: int = CUE_TTL, live: list[tuple] = ()):
        self.ttl, self.live = ttl * 1_000_000, list(live)

    def row(self, row: dict) -> list[tuple]:
        if not row["is_call"]:
            self.live.append((row["id"], row["tool"], row["at"]))
            return []
        now = row["at"]
        kept = [c for c in self.live if now is None or c[2] is None or now - c[2] <= self.ttl]
        n_expired = len(self.live) - len(kept)
        taken = next((i for i, c in enumerate(kept) if c[1] == row["tool"]), None)
        cue = kept.pop(taken) if taken is not None else (None, None, None)
        self.live = kept
        return [(row["session"], row["tool"], row["id"], cue[0], now, cue[2], n_expired)]

    def end(self) -> list[tuple]:
        return []


def _cue_times(found: DataFrame) -> DataFrame:
    return found.select("session", "tool", "call_id", "cue_id", F.timestamp_micros("call_at").alias("call_ts"), F.timestamp_micros("cue_at").alias("cue_ts"), "n_expired")


def consume_cues(events: DataFrame, ttl: int = CUE_TTL) -> DataFrame:
    """Every call with the cue it consumes, if any, and how many cues expired at it: each cue serves one call at most.

    Of events at one time cues come first, then the smaller id.
    """
    return _cue_times(keyed_fold(events, ["session"], ["at", "is_call", "id"], lambda: CueFold(ttl), CUE_RESULT))


class CueProcessor(StatefulProcessor):
    def __init__(self, ttl: int = CUE_TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", "id long, tool string, at long")
        self.result = _row_of(CUE_RESULT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold = CueFold(self.ttl, [tuple(c) for c in self.live.get()] if self.live.exists() else ())
        first = lambda r: (r["at"] is not None, r["at"] or 0, r["is_call"], r["id"])
        for r in sorted(rows, key=first):
            for made in fold.row(r.asDict()):
                yield self.result(*made)
        if fold.live:
            self.live.put(fold.live)
        else:
            self.live.clear()

    def close(self) -> None:
        pass


def consume_cues_stream(events: DataFrame, ttl: int = CUE_TTL) -> DataFrame:
    """``consume_cues`` over a stream of events."""
    return _cue_times(events.groupBy("session").transformWithState(CueProcessor(ttl), CUE_RESULT, "Append", "None"))


# ---- messages ----


class MessageFold:
    """Messages that wait, oldest first; ``append`` of an id that waits already is skipped, ``remove`` takes one id, ``clear`` all.

    What leaves is emitted.  Turns are numbered on and on, through drains.  Holds the messages of a session that wait.
    """

    def __init__(self, waiting: list[tuple] = (), turn: int = 0):
        self.waiting, self.turn = list(waiting), turn

    def row(self, row: dict) -> list[tuple]:
        if row["action"] == "append":
            if row["id"] and all(w[0] != row["id"] for w in self.waiting):
                self.waiting.append((row["id"], row["text"] or "", self.turn, row["pos"]))
                self.turn += 1
            return []
        gone = [w for w in self.waiting if row["action"] == "clear" or w[0] == row["id"]]
        self.waiting = [w for w in self.waiting if w not in gone]
        return [(row["session"], *w, row["pos"]) for w in gone]

    def end(self) -> list[tuple]:
        return []


def drain_messages(events: DataFrame) -> DataFrame:
    """Messages that leave a session's queue, from events (session, pos, action, id, text) in order of pos; rows without an id or with another action do nothing."""
    events = events.where("action IN ('append', 'remove', 'clear')")
    return keyed_fold(events, ["session"], ["pos"], MessageFold, MESSAGE_RESULT)


class MessageProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "id string, text string, turn long, pos long")
        self.turn = handle.getValueState("turn", "turn long")
        self.result = _row_of(MESSAGE_RESULT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold = MessageFold([tuple(w) for w in self.waiting.get()] if self.waiting.exists() else (), self.turn.get()[0] if self.turn.exists() else 0)
        for r in sorted(rows, key=lambda r: (r["pos"] is not None, r["pos"] or 0)):
            for made in fold.row(r.asDict()):
                yield self.result(*made)
        self.turn.update((fold.turn,))
        if fold.waiting:
            self.waiting.put(fold.waiting)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def drain_messages_stream(events: DataFrame) -> DataFrame:
    """``drain_messages`` over a stream of events."""
    events = events.where("action IN ('append', 'remove', 'clear')")
    return events.groupBy("session").transformWithState(MessageProcessor(), MESSAGE_RESULT, "Append", "None")
