"""Packed token ids: best-fit decreasing with a segment tree over room, written as fixed-width rows.

Each task packs its own documents, ``BLOCK`` tokens at a time, so nothing is shuffled, memory is
bounded, and a lost task repeats alone.  A document is its ids and a closing id; longer ones are cut
into pieces of at most ``width`` ids, without losing any.  Pieces go, longest first, into the open
row with the least room that suffices; a segment tree over room finds it in logarithmic time.

A row of the result is one row of the id matrix: ``ids`` (little-endian unsigned 16-bit, or 32-bit for
larger vocabularies, filled up with the closing id), ``cu_seqlens`` (0 and the running lengths, for
variable-length attention), ``position_resets`` (where positions start again from ``position_starts``, as
a piece after the first goes on where its document was cut), and the pieces' doc_ids and starts.

Null texts count as empty: the closing id alone.  Repeated rows are packed one by one; null doc_ids
stay null.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents, slices, trim
from tessera.llm.encoding import encoder

TOKENIZER = "byte_bpe_50k.json"
CLOSING = 50256
WIDTH = 4096
#: Tokens that are packed together in a task; a sixteenth as many pieces, so that short documents stay bounded too.
BLOCK = 8_000_000

SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "position_starts array<long>, doc_ids array<long>"
)


class RoomTree:
    """Counts of open rows by room, 0 to ``most``; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, size: int) -> int:
        """Least room of at least ``size`` with an open row, or -1."""
        k = size + self.leaves
        if self.count[k]:
            return size
        while k > 1:
            if not k & 1 and self.count[k + 1]:  # the subtree to the right holds larger rooms
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows as lists of positions in ``sizes``, none over ``width``."""
    tree, open_ = RoomTree(width), [[] for _ in range(width + 1)]
    rows: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room < 0:
            row = len(rows)
            rows.append([])
            room = width
        else:
            row = open_[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        open_[room - sizes[i]].append(row)
        tree.add(room - sizes[i], 1)
    return rows


def pack_ids(docs: DataFrame, tokenizer: str = TOKENIZER, closing: int = CLOSING, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The packed rows of ``docs``; see the module's text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    bytes_each = 2 if closing < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, bytes_each)
        end = closing.to_bytes(bytes_each, "little")
        step = width * bytes_each
        number = TaskContext.get().partitionId() << 32
        pieces: list[tuple[int | None, int, bytes]] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number
            sizes = [len(data) // bytes_each for _, _, data in pieces]
            made: list[tuple] = []
            for row in best_fit_decreasing(sizes, width):
                at = np.cumsum([0, *(sizes[i] for i in row)]).tolist()
                data = b"".join([pieces[i][2] for i in row])
                made.append((
                    number, at[-1], data + end * (width - at[-1]), at, at[:-1], [pieces[i][1] for i in row], [pieces[i][0] for i in row]
                ))
                number += 1
                if len(made) == 256:
                    yield batch_of(made)
                    made = []
            if made:
                yield batch_of(made)

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = enc.encode(text) + end
                    pieces += [(doc, at // bytes_each, data[at : at + step]) for at in range(0, len(data), step)]
                    held += len(data) // bytes_each
                    if held >= block or len(pieces) >= block // 16:
                        yield from rows()
                        pieces, held = [], 0
        if pieces:
            yield from rows()
        trim()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_ids(documents(spark, sf_dir))
