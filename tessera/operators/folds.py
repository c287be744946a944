"""Rules that depend on the order of a key's rows, as folds over sorted runs.

A task holds the state of one key at a time and a bounded slice of rows, however many rows a key has; what the
state may hold is said by each fold.  The streaming forms in tessera.streaming take the same steps from stored state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are held as Python objects at once.
SLICE = 1024


class Fold(Protocol):
    def row(self, row: dict) -> list[tuple]:
        """Takes the key's next row; what to emit."""

    def end(self) -> list[tuple]:
        """What to emit after the key's last row."""


def keyed_fold(rows: DataFrame, key: list[str], order: list[str], fold: Callable[[], Fold], schema: str) -> DataFrame:
    """The rows of each key, in order, through a fold of its own; emitted rows as ``schema``.

    Nulls are a key like any other and come first in an order.  No rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, made = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
                made.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for row in batch.slice(k, SLICE).to_pylist():
                    now = tuple(row[c] for c in key)
                    if now != at or state is None:
                        if state is not None:
                            made.extend(state.end())
                        at, state = now, fold()
                    made.extend(state.row(row))
                yield from flush()
        if state is not None:
            made.extend(state.end())
        yield from flush()

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
