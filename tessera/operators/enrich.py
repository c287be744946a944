"""Enrichment of contexts by what was asked with success: a fold over a context's emits in order.

Each emit brings queries (with vectors), keywords and entities.  A query is new if its text isn't among the context's
views and no view comes as near as ``NEAR``; both are asked of the views as they were before the emit.  New queries
follow the old, and of all only the last ``MOST_VIEWS`` stay; a view that left no longer keeps others out.
Keywords count once in lower case, entities once as ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_ascii, normalize_entity_name
from tessera.operators.folds import keyed_fold

#: Views of a context, and the cosine from which a query says nothing new.
MOST_VIEWS, NEAR = 20, 0.85

_STATS = ("added_queries", "dropped_queries", "added_keywords", "added_entities", "evicted_views")
RESULT = "context_id string, seq long, " + "".join(f"{s} int, " for s in _STATS) + "queries array<string>, vectors array<array<double>>, keywords array<string>, entities array<string>"


def entity_ids(names: str | Column) -> Column:
    """Names of an array as ids, blank ones left out."""
    c = F.col(names) if isinstance(names, str) else names
    folded = F.split(fold_ascii(F.array_join(F.filter(c, lambda x: F.trim(x) != ""), "\x01")), "\x01")
    return F.filter(F.transform(folded, lambda x: F.when(x != "", normalize_entity_name(x, fold=False))), lambda x: x.isNotNull())


def _unit(v) -> np.ndarray:
    x = np.array([] if v is None or None in v else v, np.float64)
    size = np.sqrt(x @ x)
    return x / size if size > 0 else np.zeros(0)


class EnrichFold:
    """The first row of a context is its state, later ones its emits; holds the context's views and names."""

    def __init__(self, most: int = MOST_VIEWS, near: float = NEAR):
        self.most, self.near = most, near
        self.context, self.queries, self.vectors, self.keywords, self.entities = None, [], [], [], []

    def row(self, row: dict) -> list[tuple]:
        self.context = row["context_id"]
        queries, vectors = row["queries"] or [], row["vectors"] or []
        vectors = [*vectors, *[None] * len(queries)][: len(queries)]
        if row["is_state"]:
            self.queries, self.vectors, self.keywords, self.entities = queries, vectors, list(row["keywords"] or []), list(row["entities"] or [])
            return []
        known, units = set(self.queries), [_unit(v) for v in self.vectors]
        fresh, dropped = [], 0
        for text, v in zip(queries, vectors):
            text = (text or "").strip()
            if not text or text in known:
                continue
            u = _unit(v)
            if len(u) and any(len(k) == len(u) and float(u @ k) >= self.near for k in units):
                dropped += 1
            else:
                fresh.append((text, v))
        self.queries, self.vectors = [*self.queries, *(f[0] for f in fresh)], [*self.vectors, *(f[1] for f in fresh)]
        evicted = max(0, len(self.queries) - self.most)
        self.queries, self.vectors = self.queries[evicted:], self.vectors[evicted:]
        added = []
        for have, new, form in ((self.keywords, [(k or "").strip() for k in row["keywords"] or []], str.lower), (self.entities, row["entities"] or [], str)):
            seen = {form(x.strip()) for x in have if x}
            before = len(have)
            for x in new:
                if x and form(x) not in seen:
                    seen.add(form(x))
                    have.append(x)
            added.append(len(have) - before)
        return [(self.context, row["seq"], len(fresh), dropped, *added, evicted, None, None, None, None)]

    def end(self) -> list[tuple]:
        return [(self.context, None, *[None] * len(_STATS), self.queries, self.vectors, self.keywords, self.entities)]


def _folded(contexts: DataFrame, emits: DataFrame, most: int, near: float) -> DataFrame:
    cols = ["queries", "vectors", "keywords"]
    state = contexts.select(F.col("context_id").cast("string").alias("context_id"), F.lit(True).alias("is_state"), F.lit(None).cast("long").alias("seq"), *cols, entity_ids("entities").alias("entities"))
    e = emits.where("context_id IS NOT NULL").select(
        F.col("context_id").cast("string").alias("context_id"), F.lit(False).alias("is_state"), F.col("seq").cast("long").alias("seq"), *cols, entity_ids("entities").alias("entities")
    )
    e = e.join(state.select("context_id").distinct(), "context_id", "left_semi")
    both = state.unionByName(e).withColumn("emits", ~F.col("is_state")).withColumn("vectors", F.col("vectors").cast("array<array<double>>"))
    return keyed_fold(both, ["context_id"], ["emits", "seq"], lambda: EnrichFold(most, near), RESULT)


def enrich(contexts: DataFrame, emits: DataFrame, most: int = MOST_VIEWS, near: float = NEAR) -> DataFrame:
    """Contexts (context_id, queries, vectors, keywords, entities) after all emits (context_id, seq, the same) in order of seq.

    Emits of a context that isn't there do nothing; null arrays are empty.
    """
    return _folded(contexts, emits, most, near).where("queries IS NOT NULL").select("context_id", "queries", "vectors", "keywords", "entities")


def enrichment_log(contexts: DataFrame, emits: DataFrame, most: int = MOST_VIEWS, near: float = NEAR) -> DataFrame:
    """What each emit added, dropped as nothing new, and pushed out."""
    return _folded(contexts, emits, most, near).where("queries IS NULL").select("context_id", "seq", *_STATS)
