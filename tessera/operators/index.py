"""A nearest-neighbour index as a table: vectors in lists by their nearest centroid, of which a query visits a few.

``fit`` learns centroids from a bounded sample and measures, on queries and neighbours of that sample, how many lists a
query must visit for the wanted recall; a larger table has nearer neighbours, so the measure errs to the safe
side.  Every vector is assigned, whatever the sample was.  A list of more than ``PART`` vectors is cut into parts by
hash, so that no task holds more than that, and searches are joins by list and part; any number of queries
will do.  Visiting all lists gives the rows of ``vector.cosine_top_k``, whose rounding and ties this shares.

Vectors without components, with nulls, without a direction or of another length than the centroids are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType

from tessera.operators.ranking import top_k

#: Rows of the sample, and numbers in it, at most.
SAMPLE, NUMBERS = 20_000, 8_000_000
#: Centroids at most, steps of fitting, and queries of the sample for which recall is measured.
MOST_LISTS, STEPS, TRIALS = 4096, 12, 200
#: Wanted mean recall of the ten nearest, measured in the sample.
RECALL, NEIGHBOURS = 0.95, 10
#: Vectors of a part, and queries that meet it at once.
PART, SLICE = 8192, 256


def _units(rows: list, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and these with length 1."""
    at = [i for i, x in enumerate(rows) if x is not None and len(x) and (d is None or len(x) == d) and None not in x]
    x = np.array([rows[i] for i in at], np.float64).reshape(len(at), -1) if at else np.zeros((0, d or 0))
    size = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return np.array(at, np.int64)[good], x[good] / size[good, None]


@dataclass(frozen=True)
class Centroids:
    """Centroids of length 1, and how many lists a query visits."""

    points: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest lists of each row, nearest first; the smaller number wins ties."""
        return np.argsort(-(x @ self.points.T), axis=1, kind="stable")[:, :n]


def _means(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Spherical k-means from spread-out seeds; an empty list starts again at the row that is worst off."""
    rng = np.random.default_rng(seed)
    points = x[np.sort(rng.permutation(len(x))[:n])].copy()
    for _ in range(STEPS):
        sim = x @ points.T
        own = sim.argmax(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(size == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sim.max(axis=1), kind="stable")[: len(empty)]]
            size = np.sqrt((sums * sums).sum(axis=1))
        points = sums / size[:, None]
    return points


def _needed(x: np.ndarray, points: np.ndarray, recall: float, seed: int) -> int:
    """Fewest lists for which queries of the sample find the wanted share of their nearest neighbours in it."""
    trial = np.random.default_rng(seed + 1).permutation(len(x))[:TRIALS]
    sim = x[trial] @ x.T
    sim[np.arange(len(trial)), trial] = -2
    k = min(NEIGHBOURS, len(x) - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    own = (x @ points.T).argmax(axis=1)
    order = np.argsort(-(x[trial] @ points.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of every list in the order of a query
    reached = np.take_along_axis(place, own[near], axis=1)
    share = np.cumsum(np.bincount(reached.ravel(), minlength=len(points))) / reached.size
    return int(np.searchsorted(share, recall - 1e-12)) + 1


def fit(vectors: DataFrame, lists: int | None = None, recall: float = RECALL, sample: int = SAMPLE, seed: int = 7) -> Centroids:
    """Centroids for a table (id, embedding) of any size, from its ``sample`` rows of the least hashes of their ids.

    ``lists`` is the square root of the number of rows unless given; at most an eighth of the sample.
    """
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL AND size(embedding) > 0")
    n, d = rows.agg(F.count("*"), F.mode(F.size("embedding"), True)).first()
    if not n:
        return Centroids(np.zeros((1, 0)), 1)
    got = rows.where(F.size("embedding") == d).orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, NUMBERS // d))).select("embedding").toArrow()  # bounded
    _, x = _units(got.column(0).to_pylist(), d)
    if len(x) < 2:
        return Centroids(np.eye(1, d), 1)
    lists = max(1, min(lists or int(n**0.5), MOST_LISTS, len(x) // 8 or 1))
    points = _means(x, lists, seed)
    return Centroids(points, _needed(x, points, recall, seed))


def _placed(df: DataFrame, column: str, centroids: Centroids, n: int) -> DataFrame:
    """``df`` with ``unit`` (packed) and ``lists``, its n nearest; both null where there is no usable vector."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)
    kept = [c for c in df.columns if c != column]
    schema = df.select(*kept).schema.add("unit", "binary").add("lists", ArrayType(IntegerType()))
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 4 * SLICE):
                b = whole.slice(k, 4 * SLICE)
                at, x = _units(b.column(len(kept)).to_pylist(), c.points.shape[1])
                unit, lists = [None] * b.num_rows, [None] * b.num_rows
                for i, v, near in zip(at.tolist(), x, c.nearest(x, n).tolist()):
                    unit[i], lists[i] = v.tobytes(), near
                columns = [*b.columns[: len(kept)], pa.array(unit, pa.binary()), pa.array(lists, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out)], schema=out)

    return df.select(*kept, F.col(column).cast("array<double>").alias(column)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Index:
    """Centroids, the rows (list, part, id, unit, and columns to filter by), and the parts of each list."""

    centroids: Centroids
    rows: DataFrame
    parts: dict[int, int]

    def save(self, path: str) -> None:
        """Writes the rows, by list, and the centroids under a folder."""
        spark = self.rows.sparkSession
        c = self.centroids
        points = [(i, [float(v) for v in p], c.probes, self.parts.get(i, 0)) for i, p in enumerate(c.points)]  # MOST_LISTS at most
        spark.createDataFrame(points, "list int, point array<double>, probes int, parts int").coalesce(1).write.parquet(f"{path}/lists")
        self.rows.repartition("list", "part").write.partitionBy("list").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> Index:
    got = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return Index(Centroids(np.array([r.point for r in got]), got[0].probes), spark.read.parquet(f"{path}/rows"), {r.list: r.parts for r in got if r.parts})


def build(vectors: DataFrame, centroids: Centroids | None = None, **how) -> Index:
    """An index of all rows (id, embedding, further columns to filter by); ``how`` goes to ``fit``."""
    centroids = centroids or fit(vectors, **how)
    rows = _placed(vectors, "embedding", centroids, 1).where("lists IS NOT NULL").withColumn("list", F.col("lists")[0]).drop("lists")
    size = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS at most
    parts = {k: -(-n // PART) for k, n in size.items()}
    return Index(centroids, rows.withColumn("part", _part(F.xxhash64("id"), parts)), parts)


def _part(h, parts: dict[int, int]):
    """The part of a row: only lists that are cut need to be looked up."""
    cut = {k: n for k, n in parts.items() if n > 1}
    if not cut:
        return F.lit(0)
    n = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in cut.items() for x in kv)), F.col("list")), F.lit(1))
    return F.pmod(h, n).cast("int")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest of each query (query_id, view, query), as ``vector.cosine_top_k`` gives them: query_id, view, id, similarity, rank.

    ``exclude`` (query_id, id) are left out before ranking: the index gives as many more as a query excludes.
    """
    n = min(probes or index.centroids.probes, len(index.centroids.points))
    rows = index.rows
    parts = F.create_map(*(F.lit(x) for kv in (index.parts or {0: 1}).items() for x in kv))
    q = queries.select("query_id", "view", "query")
    more = F.lit(0)
    if exclude is not None:
        q = q.join(exclude.groupBy("query_id").agg(F.countDistinct("id").cast("int").alias("more")), "query_id", "left")
        more = F.coalesce("more", F.lit(0))
    q = _placed(q.select("query_id", "view", more.alias("more"), "query"), "query", index.centroids, n).where("lists IS NOT NULL")
    q = q.select("query_id", "view", "more", "unit", F.explode("lists").alias("list")).withColumn("n", F.element_at(parts, F.col("list")))
    q = q.where("n IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    kinds = dict(q.dtypes) | dict(rows.dtypes)
    none = lambda *c: [F.lit(None).cast(kinds[x]).alias(x) for x in c]
    both = rows.select("list", "part", F.lit(False).alias("asks"), "id", "unit", *none("query_id", "view", "more")).unionByName(
        q.select("list", "part", F.lit(True).alias("asks"), *none("id"), "unit", "query_id", "view", "more")
    )
    schema = both.select("query_id", "view", "id").schema.add("similarity", "double")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, x, ids = None, [], None, None

        def unpacked(parts: list[pa.RecordBatch]) -> np.ndarray:
            packed = [v for p in parts for v in p.column("unit").to_pylist()]
            return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)

        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "part", "asks")], axis=1)
                cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for s, e in zip(cut, cut[1:]):
                    run_of = b.slice(s, e - s)
                    if at is None or (keys[s, :2] != at).any():
                        at, held, x = keys[s, :2], [], None
                    if not keys[s, 2]:
                        held.append(run_of)
                        continue
                    if not held:
                        continue
                    if x is None:  # PART rows or so, in order of id
                        x, ids = unpacked(held), pa.chunked_array([h.column("id") for h in held]).combine_chunks()
                    sim = unpacked([run_of]) @ x.T
                    want = np.minimum(run_of.column("more").to_numpy() + k, len(x))
                    deepest = int(want.max())
                    best = -np.sort(-sim, axis=1)[:, :deepest] if deepest < len(x) else -np.sort(-sim, axis=1)
                    least = best[np.arange(len(sim)), want - 1] - 2e-6  # what rounding to 6 may put beside the last
                    q_at, x_at = np.nonzero(sim >= least[:, None])
                    columns = [run_of.column("query_id").take(pa.array(q_at)), run_of.column("view").take(pa.array(q_at)), ids.take(pa.array(x_at)), pa.array(sim[q_at, x_at])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    hits = both.repartition("list", "part").sortWithinPartitions("list", "part", "asks", "id").mapInArrow(run, schema)
    hits = hits.withColumn("similarity", F.round("similarity", 6))
    if exclude is not None:
        hits = hits.join(exclude.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti").select("query_id", "view", "id", "similarity")
    return top_k(hits, ["query_id", "view"], [F.desc("similarity"), "id"], k)
