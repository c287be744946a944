"""Near copies among vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more are at a squared distance of at most T = 2 - 2c.  A rotation keeps distances and
spreads them evenly over the coordinates, which are cut into blocks; a block of b of d coordinates has the budget
T b / d.  The budgets sum to T, so a near pair keeps to the budget of at least one block.

1. Vectors that are equal, with equal labels, are one class with a weight.  Classes are rotated once and written.
2. Each block is a range join of its own.  The signs of a block's first coordinates are a cell; there are as many as
   give a cell about ``CELL`` classes of a label.  Crossing a coordinate's zero costs at least its square, so a class
   visits just the cells whose crossings together keep to the budget, of which it takes those of a higher number.
3. A cell and its visitors are cut into tiles of bounded size on both sides.  A tile, given the block's coordinates
   alone, tells which of its classes have a candidate.
4. Only these send their whole vectors.  A tile verifies its candidates exactly; a pair counts in the first block whose
   budget it keeps to, so it counts once.  Tiles give sums of links by class and links as stars, never pairs.
5. Links give the connected components.

The join is exact: every pair of cosine ``least`` or more is found.  Vectors that are null, zero, of no length or with
null or non-finite components link with nothing, nor do those without a label or of different lengths.  Each row is a
vector of its own, so rows that repeat link with each other.  Rows without a vec_id link as others do, also
as a bridge, but give a group no name.  Other columns are ignored.  Classes and tiles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import stars
from tessera.llm.common import checkpointed, connected_components, slices, table, trim
from tessera.llm.jaccard_join import Groups

LEAST = 0.93
#: Coordinates of a block.
BLOCK = 16
#: Classes of a label that a cell should have, and bits of a cell at most.
CELL, MOST_BITS = 1024, 12
#: Classes on either side of a tile.
HOME, VISITORS = 2048, 8192
#: Slack for rounding: relative for sums of squares in double precision, absolute for narrow coordinates.
SLACK, NARROW = 1e-9, 1e-5
SEED = 11

_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d coordinates."""
    if d not in _rotations:
        _rotations[d] = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0]
    return _rotations[d]


def block_budgets(d: int, least: float = LEAST) -> list[tuple[int, int, float]]:
    """(begin, end, squared distance) of each block of d coordinates; the distances sum to that of a pair of cosine ``least``."""
    n = -(-d // BLOCK)
    ends = [round(k * d / n) for k in range(n + 1)]
    return [(x, y, (2 - 2 * least) * (y - x) / d * (1 + SLACK) + SLACK) for x, y in zip(ends, ends[1:])]


def visits(x: np.ndarray, bits: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each row of block coordinates; and (row, cell) of the cells of higher number within the budget."""
    own = ((x[:, :bits] >= 0) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(x), np.int64)
    row, cell, used = np.arange(len(x)), own.copy(), np.zeros(len(x))
    for i in range(bits):
        more = used + x[row, i] ** 2
        go = more <= budget
        row, cell, used = np.concatenate([row, row[go]]), np.concatenate([cell, cell[go] ^ (1 << i)]), np.concatenate([used, more[go]])
    up = cell > own[row]
    return own, row[up], cell[up]


def squared(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of u to all of v."""
    return np.maximum((u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None] - 2 * (u @ v.T), 0)


def settled(values: np.ndarray, bound: float, below: bool, exact, near: float = 1e-9) -> np.ndarray:
    """values <= bound (or >=), where those too close to tell are taken from ``exact(rows, columns)``."""
    out = values <= bound if below else values >= bound
    i, j = np.nonzero(np.abs(values - bound) <= near)
    for k in range(0, len(i), 4096):
        part = slice(k, k + 4096)
        e = exact(i[part], j[part])
        out[i[part], j[part]] = e <= bound if below else e >= bound
    return out


class Tile:
    """The home side of a tile, and what its visitors have in common with it."""

    def __init__(self, block: int, least: float, key: np.ndarray, weight: np.ndarray, turned: np.ndarray, vectors: np.ndarray):
        self.block, self.least, self.key, self.weight, self.turned = block, least, key, weight, turned
        self.vectors, self.length = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.budgets = block_budgets(turned.shape[1], least)
        self.sums: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []
        self.groups, self.at = Groups(len(key)), {int(k): i for i, k in enumerate(key)}

    def meet(self, key: np.ndarray, home: np.ndarray, weight: np.ndarray, turned: np.ndarray, vectors: np.ndarray) -> None:
        """Links of some visitors; those that live in this cell (``home``) meet smaller keys only."""
        length = np.sqrt((vectors * vectors).sum(axis=1))

        def cosine(i, j):
            return (vectors[i] * self.vectors[j]).sum(axis=1) / (length[i] * self.length[j])

        found = settled((vectors @ self.vectors.T) / (length[:, None] * self.length[None]), self.least, False, cosine)
        found &= ~home[:, None] | (key[:, None] > self.key[None])
        for k in range(self.block + 1):  # found here if no block before this one finds it
            x, y, budget = self.budgets[k]
            if not found.any():
                return

            def apart(i, j, x=x, y=y):
                return ((turned[i, x:y] - self.turned[j, x:y]) ** 2).sum(axis=1)

            near = settled(squared(turned[:, x:y], self.turned[:, x:y]), budget, True, apart)
            found &= near if k == self.block else ~near
        counted = found.astype(np.float64)
        for keys, n in ((key, counted @ self.weight), (self.key, weight @ counted)):
            for i in np.flatnonzero(n).tolist():
                c = int(keys[i])
                self.sums[c] = self.sums.get(c, 0) + int(n[i])
        self._span(key, found)

    def _span(self, key: np.ndarray, found: np.ndarray) -> None:
        """Keeps links that join what was apart: one for each visitor and group of the home side that it links with."""
        label = self.groups.label
        for i in np.flatnonzero(found.any(axis=1)).tolist():
            j = np.flatnonzero(found[i])
            first, *more = j[np.unique(label[j], return_index=True)[1]].tolist()
            own = self.at.get(int(key[i]), first)
            for x in (first, *more):
                if x == own or label[x] != label[own]:
                    self.forest.append((int(self.key[x]), int(key[i])))
                self.groups.join(x, own)

    def rows(self) -> list[tuple[int, int | None, int | None]]:
        """(key, other, links): links of a class, or an edge."""
        return [(k, None, n) for k, n in self.sums.items()] + [(a, b, None) for a, b in stars(self.forest)]


def classes(vectors: DataFrame) -> DataFrame:
    """space, key, weight, vector (packed doubles) and vec_id, the least of the class; the space is the label and the length."""
    v = vectors.where("label IS NOT NULL AND cls IS NOT NULL")
    return v.groupBy("space", F.col("cls").alias("key")).agg(F.count("*").alias("weight"), F.first("vector").alias("vector"), F.min("vec_id").alias("vec_id"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, space, cls, vector: the packed vector and its class; null in vectors that link with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("d", pa.int32()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = []
                for x in part.column(2).to_pylist():
                    a = np.array([] if x is None or any(c is None for c in x) else x, np.float64)
                    made.append((a + 0.0).tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)  # + 0.0: no negative zeros
                d = pa.array([m and len(m) // 8 for m in made], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), d, pa.array(made, pa.binary())], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(run, "vec_id long, label string, d int, vector binary")
    known = F.col("vector").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("space", F.when(known, F.xxhash64("label", "d")))
    return rows.withColumn("cls", F.when(known, F.xxhash64("label", "d", "vector")))


def turned(found: DataFrame) -> DataFrame:
    """Classes with ``turned``, their rotated unit vectors; ``vector`` is scaled by a power of two so that squares neither overflow nor vanish."""
    schema = pa.schema([("space", pa.int64()), ("key", pa.int64()), ("weight", pa.int64()), ("vector", pa.binary()), ("turned", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                vectors = part.column("vector").to_pylist()
                scaled, out = [None] * len(vectors), [None] * len(vectors)
                size = np.array([len(v) for v in vectors])
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n).tolist()
                    x = np.frombuffer(b"".join([vectors[i] for i in at]), np.float64).reshape(len(at), -1)
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                    y = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ rotation(n // 8)
                    for i, a, b in zip(at, x, y):
                        scaled[i], out[i] = a.tobytes(), b.tobytes()
                columns = [*(part.column(c) for c in ("space", "key", "weight")), pa.array(scaled, pa.binary()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        trim()

    return found.select("space", "key", "weight", "vector").mapInArrow(run, "space long, key long, weight long, vector binary, turned binary")


def cell_bits(rows: DataFrame) -> int:
    """Bits of a cell, so that the largest space has about ``CELL`` classes in each."""
    most = rows.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    return min(MOST_BITS, max(0, -(-most // CELL) - 1).bit_length())


def places(rows: DataFrame, bits: int, least: float = LEAST) -> DataFrame:
    """space, block, budget, cell, home, key, part: where each class lives and visits, with the block's coordinates as packed floats."""
    schema = pa.schema([
        ("space", pa.int64()), ("block", pa.int32()), ("budget", pa.float64()), ("cell", pa.int32()), ("home", pa.bool_()), ("key", pa.int64()), ("part", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                packed = part.column("turned").to_pylist()
                size, space, key = np.array([len(x) for x in packed]), part.column("space").to_numpy(), part.column("key").to_numpy()
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    x = np.frombuffer(b"".join([packed[i] for i in at.tolist()]), np.float64).reshape(len(at), -1)
                    for k, (begin, end, budget) in enumerate(block_budgets(n // 8, least)):
                        own, row, cell = visits(x[:, begin:end], min(bits, end - begin), budget)
                        row, cell = np.concatenate([np.arange(len(at)), row]), np.concatenate([own, cell])
                        narrow = [a.tobytes() for a in x[:, begin:end].astype(np.float32)]
                        columns = [
                            space[at][row], np.full(len(row), k), np.full(len(row), budget), cell, np.arange(len(row)) < len(at), key[at][row], [narrow[i] for i in row.tolist()],
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        trim()

    return rows.select("space", "key", "turned").mapInArrow(run, "space long, block int, budget double, cell int, home boolean, key long, part binary")


def tiles(rows: DataFrame) -> DataFrame:
    """tile, block, budget, side, home, key, part: side 0 is the tile's home, side 1 visits; a cell's own classes are on both."""
    cell = ["space", "block", "cell"]
    size = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("m")).where("n > 1 AND m > 0")
    pieces = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    rows = rows.join(size.select(*cell, pieces("m", HOME).alias("homes"), pieces("n", VISITORS).alias("guests")), cell)
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n: F.pmod(F.xxhash64("key", F.lit(n)), F.col(n)).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), at("homes").alias("own"), to("guests").alias("other")), F.struct(F.lit(1).alias("side"), at("guests").alias("own"), to("homes").alias("other")))
    rows = rows.select("*", F.explode(sides).alias("s")).where("home OR s.side = 1").select("*", F.explode("s.other").alias("other"))
    i, j = F.when(F.col("s.side") == 0, F.col("s.own")).otherwise(F.col("other")), F.when(F.col("s.side") == 0, F.col("other")).otherwise(F.col("s.own"))
    return rows.select(F.xxhash64(*cell, i, j).alias("tile"), "block", "budget", F.col("s.side").alias("side"), "home", "key", "part")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(tile, side, rows) of the runs of a sorted batch, of bounded size."""
    for part in slices(batch, 1 << 20):
        tile, side = part.column("tile").to_numpy(), part.column("side").to_numpy()
        cut = [0, *(np.flatnonzero((tile[1:] != tile[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(tile)]
        for x, y in zip(cut, cut[1:]):
            yield int(tile[x]), int(side[x]), part.slice(x, y - x)


def _matrix(rows: list[pa.RecordBatch], column: str, kind=np.float64) -> np.ndarray:
    packed = [x for r in rows for x in r.column(column).to_pylist()]
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1)


def _column(rows: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([r.column(column).to_numpy(zero_copy_only=False) for r in rows])


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile", "side", "key")


def candidates(rows: DataFrame) -> DataFrame:
    """tile, block, side, home, key of those that are within the block's budget of another in a tile."""
    schema = pa.schema([("tile", pa.int64()), ("block", pa.int32()), ("side", pa.int32()), ("home", pa.bool_()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, here = None, [], None

        def hits(rows: list[pa.RecordBatch], side: int, yes: np.ndarray) -> pa.RecordBatch:
            n = int(yes.sum())
            columns = [np.full(n, at), _column(rows, "block")[yes], np.full(n, side, np.int32), _column(rows, "home")[yes], _column(rows, "key")[yes]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for tile, side, part in _runs(batch):
                if tile != at:
                    if here is not None and here[2].any():
                        yield hits(homes, 0, here[2])
                    at, homes, here = tile, [], None
                if side == 0:
                    homes.append(part)
                    continue
                if not homes:
                    continue
                if here is None:
                    x = _matrix(homes, "part", np.float32)
                    here = [x, _column(homes, "key"), np.zeros(len(x), bool)]
                y, key, home = _matrix([part], "part", np.float32), _column([part], "key"), _column([part], "home")
                near = squared(y, here[0]) <= part.column("budget")[0].as_py() + NARROW
                near &= ~home[:, None] | (key[:, None] > here[1][None])
                if near.any():
                    here[2] |= near.any(axis=0)
                    yield hits([part], 1, near.any(axis=1))
        if here is not None and here[2].any():
            yield hits(homes, 0, here[2])
        trim()

    return _by_tile(rows).mapInArrow(run, "tile long, block int, side int, home boolean, key long")


def links(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """key, other, links from candidates with whole vectors: sums of links of a class (other is null), or an edge."""
    schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, here = None, [], None

        def content(rows: list[pa.RecordBatch]) -> tuple:
            return _column(rows, "weight"), _matrix(rows, "turned"), _matrix(rows, "vector")

        def done() -> Iterator[pa.RecordBatch]:
            if here is not None and (made := here.rows()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=schema)

        for batch in batches:
            for tile, side, part in _runs(batch):
                if tile != at:
                    yield from done()
                    at, homes, here = tile, [], None
                if side == 0:
                    homes.append(part)
                elif homes:
                    if here is None:
                        here = Tile(part.column("block")[0].as_py(), least, _column(homes, "key"), *content(homes))
                    here.meet(_column([part], "key"), _column([part], "home"), *content([part]))
        yield from done()
        trim()

    return _by_tile(rows).mapInArrow(run, "key long, other long, links long")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    own = checkpointed(usable(vectors))
    found = classes(own)
    rows = checkpointed(turned(found))
    hits = checkpointed(candidates(tiles(places(rows, cell_bits(rows), least))))
    made = checkpointed(links(hits.join(rows.select("key", "weight", "turned", "vector"), "key"), least))
    sums = made.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    parts = connected_components(made.where("other IS NOT NULL").select(F.col("key").alias("src"), F.col("other").alias("dst")))
    named = found.select("key", "weight", "vec_id").join(parts.select(F.col("node").alias("key"), "component"), "key", "left")
    named = named.join(sums, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least_id, "component").select(F.col("key").alias("cls"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = own.where("cls IS NOT NULL").select("vec_id", "cls").join(named, "cls").select("vec_id", "n_links", "component_id")
    alone = own.where("cls IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
