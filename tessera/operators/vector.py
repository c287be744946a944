"""Similarity search and joins over embeddings.

Queries are a stated set that is compared with all rows in blocks: the queries, of which there is a bounded
number, are sent to every task, which multiplies them with a block of vectors at a time and keeps what may be
among the nearest.  Vectors are never paired among themselves.  A vector that is missing, has no direction, holds nulls
or has another length than a query has similarity 0 with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, _parse_datatype_string

from tessera.operators.ranking import top_k

#: Thresholds of similarity.
REUSE_IDENTITY, COLLISION = 0.92, 0.85
CONTEXT_REUSE, CONTEXT_SIMILAR = 0.90, 0.65
#: Query vectors at once, and numbers in them.
MOST_QUERIES, MOST_NUMBERS = 100_000, 20_000_000
#: Vectors and queries of a block.
BLOCK, QUERIES = 2048, 512
#: Vectors of a block that are settled by owner.
OWNERS = 2048
#: Queries at least and at most of a task that meets all vectors, and similarities that it holds at once.
FEWEST, SIMILARITIES = 16, 4_000_000


def hashing_embedder(dims: int = 64) -> Callable[[Column | str], Column]:
    """An offline embedder: signed counts of hashed words, unit length, as an Arrow function."""

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        import xxhash

        v = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):  # one text at a time as a Python object
            for w in (t.as_py() or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[i, h % dims] += 1 if h >> 63 else -1
        n = np.sqrt((v * v).sum(axis=1))
        v /= np.where(n > 0, n, 1)[:, None]
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dims, v.ravel())

    return embed


def _units(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the vectors that have a direction, and these with length 1."""
    size = np.array([0 if x is None or None in x else len(x) for x in rows], np.int64)
    out = {}
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        x = np.array([rows[i] for i in at.tolist()], np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        out[d] = at[good], x[good] / norm[good, None]
    return out


def _compared(queries: DataFrame, vectors: DataFrame, k: int | None = None, more: Column | None = None) -> DataFrame:
    """(query_id, view, id, similarity) of queries with vectors: of all, or, for ``k``, of those that may be among the k nearest.

    ``more`` is how many more than k a query wants.
    """
    q = queries.select("query_id", "view", F.col("query").cast("array<double>").alias("query"), (F.lit(0) if more is None else more).cast("int").alias("more"))
    got = q.limit(MOST_QUERIES + 1).toArrow()
    rows = got.column("query").to_pylist()
    if len(rows) > MOST_QUERIES or sum(len(x) for x in rows if x) > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_QUERIES} query vectors or {MOST_NUMBERS} numbers in them: split them into batches, or use an index")
    names = got.select(["query_id", "view"]).combine_chunks()
    sent = vectors.sparkSession.sparkContext.broadcast((names, _units(rows), got.column("more").to_numpy()))
    schema = StructType([q.schema["query_id"], q.schema["view"], vectors.schema["id"], StructField("similarity", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units, more = sent.value
        floor = np.full(len(more), -np.inf)  # what the task's blocks so far have at the last place that a query wants
        for whole in batches:
            for at in range(0, whole.num_rows if len(more) else 0, BLOCK):
                part = whole.slice(at, BLOCK)
                mine = _units(part.column(1).to_pylist())
                for begin in range(0, len(more), QUERIES):
                    sim = np.zeros((min(QUERIES, len(more) - begin), part.num_rows))
                    for d, (of, x) in units.items():
                        low, high = np.searchsorted(of, (begin, begin + QUERIES))
                        if d in mine and high > low:
                            sim[np.ix_(of[low:high] - begin, mine[d][0])] = x[low:high] @ mine[d][1].T
                    keep = np.ones(sim.shape, bool)
                    if k is not None:
                        own = floor[begin : begin + len(sim)]
                        want = k + more[begin : begin + len(sim)]
                        full = np.flatnonzero(want <= part.num_rows)
                        if len(full):
                            last = part.num_rows - want[full]
                            own[full] = np.maximum(own[full], np.partition(sim[full], np.unique(last), axis=1)[np.arange(len(full)), last])
                        keep = sim >= own[:, None] - 2e-6  # what rounding to 6 may put beside the last
                    i, j = np.nonzero(keep)
                    of = pa.array(i + begin)
                    columns = [names.column("query_id").take(of), names.column("view").take(of), part.column(0).take(pa.array(j)), pa.array(sim[i, j])]
                    for c in range(0, len(i), 1 << 16):
                        cut = [x.slice(c, 1 << 16) for x in columns]
                        cut = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cut]
                        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cut, out)], schema=out)

    return vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)


def score_queries(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, view, id, similarity) of every query (query_id, view, query) with every vector (id, embedding)."""
    return _compared(queries, vectors)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest vectors of each query view, rounded to 6 before ranking; ``exclude`` (query_id, id) are left out."""
    if exclude is None:
        scored = _compared(queries, vectors, k).withColumn("similarity", F.round("similarity", 6))
    else:
        out = exclude.select("query_id", "id").distinct()
        counted = queries.join(out.groupBy("query_id").agg(F.count("*").alias("__more")), "query_id", "left")
        scored = _compared(counted, vectors, k, F.coalesce("__more", F.lit(0))).withColumn("similarity", F.round("similarity", 6))
        scored = scored.join(out, ["query_id", "id"], "left_anti").select("query_id", "view", "id", "similarity")
    return top_k(scored, ["query_id", "view"], [F.desc("similarity"), "id"], k)


def collapse_views(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Hits on physical views (id) as hits on their owners: the best similarity counts, rounded to 3."""
    return hits.join(owners.select("id", "owner_id"), "id").groupBy("query_id", "view", "owner_id").agg(F.round(F.max("similarity"), 3).alias("similarity"))


def _by_query(queries: DataFrame) -> tuple[pa.Array, int, np.ndarray, np.ndarray, dict]:
    """The queries' ids; of all their vectors in order: the number, where each view begins, which view begins each query, and the units."""
    q = queries.select("query_id", "view", F.col("query").cast("array<double>").alias("query"))
    got = q.limit(MOST_QUERIES + 1).toArrow()
    rows = got.column("query").to_pylist()
    if len(rows) > MOST_QUERIES or sum(len(x) for x in rows if x) > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_QUERIES} query vectors or {MOST_NUMBERS} numbers in them: split them into batches, or use an index")
    at: dict = {}
    for i, key in enumerate(zip(got.column("query_id").to_pylist(), got.column("view").to_pylist())):
        at.setdefault(key[0], {}).setdefault(key[1], []).append(i)
    each = [rows_of for views in at.values() for rows_of in views.values()]
    begins = lambda sizes: np.cumsum([0, *sizes], dtype=np.int64)[:-1]
    names = pa.array(list(at), got.schema.field("query_id").type)
    return names, len(rows), begins(map(len, each)), begins(map(len, at.values())), _units([rows[i] for x in each for i in x])


def per_view_maxima(queries: DataFrame, views: DataFrame) -> DataFrame:
    """(query_id, view, owner_id, best): for each query view and owner the best cosine over the owner's views, 0 at least."""
    scored = score_queries(queries, views).join(views.select("id", "owner_id"), "id")
    return scored.groupBy("query_id", "view", "owner_id").agg(F.greatest(F.max("similarity"), F.lit(0.0)).alias("best"))


def min_max_similarity(queries: DataFrame, views: DataFrame) -> DataFrame:
    """(query_id, owner_id, max_sim, min_sim) over the query's views, in one pass.

    An owner's vectors come to one task, one after the other, and all queries are there: vectors travel, pairs don't.
    """
    sent = views.sparkSession.sparkContext.broadcast(_by_query(queries))
    rows = views.where("id IS NOT NULL").select("owner_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([queries.schema["query_id"], views.schema["owner_id"], StructField("max_sim", DoubleType()), StructField("min_sim", DoubleType())])
    out = to_arrow_schema(schema)

    def emit(names: pa.Array, chunk: tuple, best: np.ndarray, owners: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk's queries from the best of each query vector and owner."""
        begin, _, _, of_view, of_query = chunk
        best = np.maximum.reduceat(best, of_view, axis=0)
        high, low = (f.reduceat(best, of_query, axis=0).ravel() for f in (np.maximum, np.minimum))
        for c in range(0, len(high), 1 << 16):
            at = np.arange(c, min(c + (1 << 16), len(high)))
            columns = [names.take(pa.array(begin + at // len(owners))), owners.take(pa.array(at % len(owners))), pa.array(high[at]), pa.array(low[at])]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, of_view, of_query, units = sent.value
        chunks, k = [], 0
        while k < len(names):
            first = of_view[of_query]
            m = max(k + 1, int(np.searchsorted(np.append(first[1:], n), first[k] + QUERIES, side="right")))
            stop = of_query[m] if m < len(names) else len(of_view)
            high = of_view[stop] if m < len(names) else n
            chunks.append((k, first[k], high, of_view[of_query[k] : stop] - first[k], of_query[k:m] - of_query[k]))
            k = m
        at, held = None, np.zeros(n)  # the owner whose vectors may go on in the next block, and its best with each query vector
        for whole in batches if chunks else ():
            for begin in range(0, whole.num_rows, OWNERS):
                part = whole.slice(begin, OWNERS)
                ids = part.column(0).to_pylist()
                start = np.array([0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])])
                owners = part.column(0).take(pa.array(start))
                mine = _units(part.column(1).to_pylist())
                goes_on = at is not None and at[0].as_py() == ids[0]
                for chunk in chunks:
                    low, high = chunk[1:3]
                    if at is not None and not goes_on:
                        yield from emit(names, chunk, held[low:high, None], at)
                    sim = np.zeros((high - low, part.num_rows))
                    for d, (of, x) in units.items():
                        a, b = np.searchsorted(of, (low, high))
                        if d in mine and b > a:
                            sim[np.ix_(of[a:b] - low, mine[d][0])] = x[a:b] @ mine[d][1].T
                    best = np.maximum(np.maximum.reduceat(sim, start, axis=1), 0)
                    if goes_on:
                        best[:, 0] = np.maximum(best[:, 0], held[low:high])
                    held[low:high] = best[:, -1]
                    if len(owners) > 1:
                        yield from emit(names, chunk, best[:, :-1], owners[:-1])
                at = owners[-1:]
        if at is not None:
            for chunk in chunks:
                yield from emit(names, chunk, held[chunk[1] : chunk[2], None], at)

    return rows.repartition("owner_id").sortWithinPartitions("owner_id").mapInArrow(run, schema)


def per_query(queries: DataFrame, vectors: DataFrame, made: Callable[[pa.Array, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """(query_id, columns of ``schema``) that ``made`` gives for one query: it sees all ids, ascending, and their similarity.

    Of an id's vectors and a query's views the best pair counts.  Queries are dealt to tasks, and all vectors go to each of these:
    once for up to 512 queries, so that no pair travels or is sorted beyond its query.  A task holds all vectors with length 1.
    """
    of_all = _by_query(queries)
    number = len(of_all[0])
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(of_all)
    blocks = max(1, -(-number // QUERIES), min(context.defaultParallelism, -(-number // FEWEST)))
    rows = vectors.select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartitionById(blocks, "block")
    kind = StructType([queries.schema["query_id"], *_parse_datatype_string(schema)])
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, of_view, of_query, units = sent.value
        ids, parts, size, block = [], [], 0, None
        for whole in batches:
            for at in range(0, whole.num_rows if number else 0, BLOCK):
                part = whole.slice(at, BLOCK)
                ids.append(part.column(0))
                parts += [(d, of + size, x) for d, (of, x) in _units(part.column(1).to_pylist()).items()]
                size += part.num_rows
                block = part.column(2)[0].as_py()
        if block is None:
            return
        ids = pa.concat_arrays(ids)
        order = pc.sort_indices(ids, null_placement="at_start")
        ids = ids.take(order)
        same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) & pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False))
        start = np.append(0, 1 + np.flatnonzero(~same))
        ids = ids.take(pa.array(start))
        to = np.empty(size, np.int64)
        to[order.to_numpy()] = np.arange(size)
        parts = [(d, to[of], x) for d, of, x in parts]
        ends, firsts = np.append(of_query[1:], len(of_view)), np.append(of_view, n)
        step = max(1, SIMILARITIES // size)
        mine = range(block * number // blocks, (block + 1) * number // blocks)
        for begin in range(mine.start, mine.stop, step):
            some = range(begin, min(begin + step, mine.stop))
            low, high = firsts[of_query[some.start]], firsts[ends[some.stop - 1]]
            sim = np.zeros((high - low, size))
            for d, of, x in parts:
                if d in units:
                    a, b = np.searchsorted(units[d][0], (low, high))
                    sim[np.ix_(units[d][0][a:b] - low, of)] = units[d][1][a:b] @ x.T
            for k in some:
                best = sim[firsts[of_query[k]] - low : firsts[ends[k]] - low].max(axis=0)
                columns = made(ids, best if len(start) == size else np.maximum.reduceat(best, start))
                for c in range(0, len(columns[0]), 1 << 16):
                    cut = [x.slice(c, 1 << 16) for x in columns]
                    cut = [names.take(pa.array(np.full(len(cut[0]), k))), *cut]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cut, out)], schema=out)

    return rows.mapInArrow(run, kind)


def near_extremes(queries: DataFrame, views: DataFrame, near: DataFrame) -> DataFrame:
    """``min_max_similarity`` of the pairs ``near`` (query_id, owner_id): these meet the owners' vectors, so that no other pair travels."""
    sent = views.sparkSession.sparkContext.broadcast(_by_query(queries))
    rows = near.join(views.where("id IS NOT NULL").select("owner_id", F.col("embedding").cast("array<double>").alias("embedding")), "owner_id")
    schema = StructType([queries.schema["query_id"], views.schema["owner_id"], StructField("view", LongType()), StructField("best", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, of_view, of_query, units = sent.value
        number = {x: i for i, x in enumerate(names.to_pylist())}
        stops = np.append(of_query[1:], len(of_view))
        ends = np.append(of_view[1:], n)
        for whole in batches:
            ids, mine = whole.column(0).to_pylist(), _units(whole.column(2).to_pylist())
            who, view, best = [], [], []
            where = {d: dict(zip(of.tolist(), range(len(of)))) for d, (of, _) in mine.items()}
            for i, x in enumerate(ids):
                k = number[x]
                low, high = of_view[of_query[k]], ends[stops[k] - 1]
                sim = np.zeros(high - low)
                for d, (of, u) in units.items():
                    a, b = np.searchsorted(of, (low, high))
                    if b > a and i in where.get(d, ()):
                        sim[of[a:b] - low] = u[a:b] @ mine[d][1][where[d][i]]
                best.append(np.maximum(np.maximum.reduceat(sim, of_view[of_query[k] : stops[k]] - low), 0))
                view.append(np.arange(len(best[-1])))
                who.append(np.full(len(best[-1]), i))
            if ids:
                at = pa.array(np.concatenate(who))
                columns = [whole.column(0).take(at), whole.column(1).take(at), pa.array(np.concatenate(view)), pa.array(np.concatenate(best))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out)], schema=out)

    rows = rows.select("query_id", "owner_id", "embedding").mapInArrow(run, schema)
    each = rows.groupBy("query_id", "owner_id", "view").agg(F.max("best").alias("best"))
    return each.groupBy("query_id", "owner_id").agg(F.max("best").alias("max_sim"), F.min("best").alias("min_sim"))


def resolve_contexts(queries: DataFrame, views: DataFrame, reuse: float = CONTEXT_REUSE, similar: float = CONTEXT_SIMILAR, k: int = 20) -> DataFrame:
    """Per query: the context to reuse (every view is near it), or a new one with a link to the nearest.

    Candidates are owners among the ``k`` nearest of any view.
    """
    near = collapse_views(cosine_top_k(queries, views, k), views).select("query_id", "owner_id").distinct()
    m = near_extremes(queries, views, near)
    best = m.groupBy("query_id").agg(
        F.max(F.struct(F.round("min_sim", 6).alias("s"), "owner_id")).alias("lo"), F.max(F.struct(F.round("max_sim", 6).alias("s"), "owner_id")).alias("hi")
    )
    reused = F.col("lo.s") >= reuse
    return best.select(
        "query_id", reused.alias("reused"), F.when(reused, F.col("lo.owner_id")).alias("context_id"),
        F.when(~reused & (F.col("hi.s") >= similar), F.col("hi.owner_id")).alias("similar_to"), F.col("hi.s").alias("max_sim"), F.col("lo.s").alias("min_sim"),
    )


def collisions(queries: DataFrame, views: DataFrame, threshold: float = COLLISION, k: int = 20, constant: int = 60) -> DataFrame:
    """Owners near a new entity: each view's ``k`` nearest fused by reciprocal rank, kept if the best similarity reaches the threshold."""
    hits = collapse_views(cosine_top_k(queries, views, k), views)
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "view").orderBy(F.desc("similarity"), "owner_id")))
    out = ranked.groupBy("query_id", "owner_id").agg(F.sum(1.0 / (constant + F.col("r"))).alias("rrf"), F.max("similarity").alias("max_sim"))
    return out.where(F.col("max_sim") >= threshold)


def mint_decisions(queries: DataFrame, views: DataFrame, reuse: float = REUSE_IDENTITY, collide: float = COLLISION) -> DataFrame:
    """Per new entity its nearest identity view and what follows: reuse, collision or create."""
    top = cosine_top_k(queries, views, 1)
    s = F.col("similarity")
    action = F.when(s >= reuse, "reuse").when(s >= collide, "collision").otherwise("create")
    return top.select("query_id", "id", "similarity", action.alias("action"))


def nearest_or_create(queries: DataFrame, known: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Reuses the nearest known vector at or over a threshold, else null."""
    top = cosine_top_k(queries, known, 1)
    return top.select("query_id", F.when(F.col("similarity") >= threshold, F.col("id")).alias("reused"), "similarity")


def novel_queries(new: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """New query vectors that no known one comes close to."""
    top = cosine_top_k(new, known, 1)
    return top.where(F.col("similarity") < threshold).select("query_id", "similarity")
