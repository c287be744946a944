"""Alignment of two tokenizers' tokens over the same bytes, and how often any two tokens are linked corpus-wide.

1. Each text is encoded by both tokenizers once; a row keeps both id lists as packed integers, in a written table that
   later steps read, so that no text is encoded twice.
2. Token ends are running sums of token lengths in bytes.  Where both have an end, both are cut: these common cuts make
   the groups.  The B tokens that overlap an A token are a run of neighbours, so links come from repeating every A
   token over its run.  All of this is done for many texts at once, laid end to end.
3. Each task counts its own id pairs first; the counts are then summed in two shuffles, the first by pair and salt.
4. Each text looks up the counts of its links.  If there are at most ``MOST_PAIRS`` distinct pairs, their table is
   broadcast; beyond that, chunks of texts ask for the pairs they have by a join, and each gets its own small table.
   Both give the same rows.

Null and empty texts have no tokens, nor has a text that its tokens don't give back: such rows are zeros with an empty
string.  One output row for each input row, repeated rows and rows without a doc_id included.  Very long texts
take memory in proportion to themselves.  Strings of special tokens are plain text.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint_folder, checkpointed, documents, slices, trim
from tessera.llm.encoding import IdEncoder, byte_letters, load, tokenizer_path

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs that are broadcast, 17 bytes each.
MOST_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it passes their counts on.
HELD = 1_000_000
#: Parts that the rows of one pair are dealt to.
SALTS = 16
#: Bytes of texts or of packed ids that are aligned at once.
BYTES = 2 << 20

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (c.split()[0] for c in RESULT.split(", "))])
_ENCODED = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_open: dict = {}


class PlainEncoder(IdEncoder):
    """Ids of a byte-level tokenizer file, strings of special tokens as plain text."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        load(name)  # sets what the library needs
        super().__init__(name)
        self.tok = Tokenizer.from_file(tokenizer_path(name))  # an own one, as it is changed
        self.tok.encode_special_tokens = True
        self.special = []


class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER):
        import sentencepiece

        self.a, self.b = PlainEncoder(a), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        letters = byte_letters()
        entries = self.a.tok.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for s, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = len(digits[-1])
        self.digits = np.frombuffer(b"".join(d.ljust(self.width, b"\0") for d in digits), np.uint8).reshape(len(digits), self.width)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of each text by both; None where there are no tokens or they aren't the text's."""
        out = []
        pieces = self.b.encode([t or "" for t in texts], num_threads=1)
        for text, b in zip(texts, pieces):
            made = None
            if text:
                data = b" " + text.encode("utf-8", "surrogatepass")
                a = np.frombuffer(self.a.encode(" " + text), "<u4").tolist()
                if b"".join([self.a_bytes[i] for i in a]) == data and b"".join([self.b_bytes[i] for i in b]) == data:
                    made = np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()
            out.append(made)
        return out


def vocabularies(a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> Vocabularies:
    if (a, b) not in _open:
        _open[a, b] = Vocabularies(a, b)
    return _open[a, b]


class Aligned:
    """Groups and links of texts that are laid end to end; ``a`` and ``b`` hold the packed ids of each."""

    def __init__(self, v: Vocabularies, a: list[bytes], b: list[bytes]):
        self.v = v
        self.n_a, self.n_b = (np.array([len(x) // v.kind.itemsize for x in s], np.int64) for s in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(s), v.kind).astype(np.int64) for s in (a, b))
        a_size = v.a_size[self.a]
        self.a_end, self.b_end = np.cumsum(a_size), np.cumsum(v.b_size[self.b])
        first = np.searchsorted(self.b_end, self.a_end - a_size, side="right")
        self.overlaps = np.searchsorted(self.b_end, self.a_end, side="left") - first + 1
        before = np.cumsum(self.overlaps) - self.overlaps
        self.link_a = np.repeat(np.arange(len(self.a)), self.overlaps)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(before - first, self.overlaps)

    def pairs(self) -> np.ndarray:
        """The id pair of every link, as one number."""
        return self.a[self.link_a] * len(self.v.b_bytes) + self.b[self.link_b]

    def links(self) -> np.ndarray:
        """Links of each text."""
        return per_text(self.overlaps, self.n_a)

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups of each text, and its groups written as a1,a2|b1;a3|b2,b3."""
        cuts = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, self.a_end), np.searchsorted(cuts, self.b_end)
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        at_a = np.arange(len(of_a)) + np.searchsorted(of_b, of_a, side="left")
        at_b = np.arange(len(of_b)) + np.searchsorted(of_a, of_b, side="right")
        written = np.zeros((len(of_a) + len(of_b), self.v.width + 1), np.uint8)
        written[at_a, :-1], written[at_b, :-1] = self.v.digits[self.a], self.v.digits[self.b]
        written[at_a, -1], written[at_b, -1] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        ends = np.cumsum(per_text((written != 0).sum(axis=1), self.n_a + self.n_b)).tolist()
        flat = written.ravel()
        data = flat[flat != 0].tobytes()
        return per_text(last_b, self.n_b), [data[x : y - 1] for x, y in zip([0, *ends], ends)]


def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, of which it has n, one at least."""
    if not len(n):
        return np.zeros(0, np.int64)
    return np.add.reduceat(values.astype(np.int64), np.cumsum(n) - n)


class Counts:
    """Counts of id pairs by sorted pair, and whether each is the highest of its B id."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair, kind="stable")
        self.pair, self.n, self.best = pair[order], n[order], best[order]

    def result(self, v: Vocabularies, ids: list, a: list[bytes | None], b: list[bytes | None]) -> pa.RecordBatch:
        """Rows of the result for texts whose pairs are all known here."""
        has = [i for i, x in enumerate(a) if x]
        out = np.zeros((6, len(ids)), np.int64)
        written = [""] * len(ids)
        if has:
            t = Aligned(v, [a[i] for i in has], [b[i] for i in has])
            at = np.searchsorted(self.pair, t.pairs())
            n_links = t.links()
            n_groups, made = t.groups()
            out[:, has] = t.n_a, t.n_b, n_groups, n_links, per_text(self.best[at], n_links), per_text(self.n[at], n_links)
            for i, g in zip(has, made):
                written[i] = hashlib.sha256(g).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x) for x in out), pa.array(written, pa.string())], schema=_RESULT)


def encoded(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> DataFrame:
    """chunk, doc_id, a, b: packed ids of every row; texts that were encoded together are a chunk.  Written, and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, chunk = vocabularies(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, BYTES):
                ids, texts = (c.to_pylist() for c in part.columns)
                made = v.encode(texts)
                columns = [[chunk] * len(ids), ids, [m and m[0] for m in made], [m and m[1] for m in made]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENCODED)], schema=_ENCODED)
                chunk += 1
        trim()

    spark = docs.sparkSession
    to = f"{checkpoint_folder(spark)}/aligned-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, doc_id long, a binary, b binary")
    rows.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(rows.schema).parquet(to)


def _aligned(v: Vocabularies, batch: pa.RecordBatch) -> Aligned | None:
    a, b = ([x for x in batch.column(c).to_pylist() if x] for c in ("a", "b"))
    return Aligned(v, a, b) if a else None


def pair_counts(rows: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> DataFrame:
    """pair, a, b, n and best of all pairs that are linked anywhere in the encoded rows."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a, b)
        held, waiting = 0, []

        def settle() -> pa.RecordBatch:
            pair, where = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
            n = np.bincount(where, np.concatenate([w[1] for w in waiting])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], schema=schema)

        for batch in batches:
            for part in slices(batch, BYTES):
                if (t := _aligned(v, part)) is not None:
                    waiting.append(np.unique(t.pairs(), return_counts=True))
                    held += len(waiting[-1][0])
                    if held > 4 * HELD:
                        done = settle()
                        if done.num_rows > HELD:
                            yield done
                            waiting, held = [], 0
                        else:
                            waiting, held = [(done.column(0).to_numpy(), done.column(1).to_numpy())], done.num_rows
        if waiting:
            yield settle()
        trim()

    width = len(vocabularies(a, b).b_bytes)
    made = rows.select("a", "b").mapInArrow(run, "pair long, n long").withColumn("salt", F.spark_partition_id() % SALTS)
    made = made.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    made = made.withColumn("a", F.floor(F.col("pair") / width)).withColumn("b", F.col("pair") % width)
    most = F.max("n").over(Window.partitionBy("b"))  # a B id has at most as many rows as there are A ids
    return made.select("pair", "a", "b", "n", (F.col("n") == most).alias("best"))


def _by_broadcast(rows: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    got = counts.select("pair", "n", "best").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabularies(a, b), Counts(*sent.value)
        for batch in batches:
            for part in slices(batch, BYTES):
                yield known.result(v, *(c.to_pylist() for c in part.columns))
        trim()

    return rows.select("doc_id", "a", "b").mapInArrow(run, RESULT)


def _by_chunk(rows: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    asked = pa.schema([("chunk", pa.int64()), ("pair", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a, b)
        for batch in batches:
            for part in slices(batch, BYTES):
                chunks = part.column("chunk").to_numpy()
                at = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
                for x, y in zip(at, at[1:]):
                    if (t := _aligned(v, part.slice(x, y - x))) is not None:
                        pair = np.unique(t.pairs())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunks[x])), pa.array(pair)], schema=asked)
        trim()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chunk, parts, known = vocabularies(a, b), None, [], None
        for batch in batches:
            for part in slices(batch, BYTES):
                kinds = part.select(["chunk", "is_text"]).to_pandas().to_numpy().astype(np.int64)
                at = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1).tolist(), len(kinds)]
                for x, y in zip(at, at[1:]):
                    run = part.slice(x, y - x)
                    if kinds[x, 0] != chunk:
                        chunk, parts, known = kinds[x, 0], [], None
                    if not kinds[x, 1]:
                        parts.append([run.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
                        continue
                    if known is None:
                        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
                        known = Counts(*(np.concatenate(c) for c in zip(none, *parts)))
                    yield known.result(v, *(run.column(c).to_pylist() for c in ("doc_id", "a", "b")))
        trim()

    own = rows.select("chunk", "a", "b").mapInArrow(ask, "chunk long, pair long").join(counts.select("pair", "n", "best"), "pair")
    none = lambda *c: [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in c]
    own = own.select("chunk", F.lit(False).alias("is_text"), "pair", "n", "best", *none("doc_id long", "a binary", "b binary"))
    texts = rows.select("chunk", F.lit(True).alias("is_text"), *none("pair long", "n long", "best boolean"), "doc_id", "a", "b")
    dealt = own.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "is_text")
    return dealt.mapInArrow(answer, RESULT)


def align(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER, most: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``."""
    rows = encoded(docs, a, b)
    counts = checkpointed(pair_counts(rows, a, b))
    return (_by_broadcast if counts.count() <= most else _by_chunk)(rows, counts, a, b)


def groups(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> DataFrame:
    """doc_id and groups, the ids of each group as a1,a2|b1;a3|b2,b3; empty where there are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a, b)
        for batch in batches:
            for part in slices(batch, BYTES):
                ids, texts = (c.to_pylist() for c in part.columns)
                made = v.encode(texts)
                t = [m for m in made if m]
                written = iter(Aligned(v, [m[0] for m in t], [m[1] for m in t]).groups()[1] if t else [])
                out = [next(written).decode() if m else "" for m in made]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "groups"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
