"""One object over the tables, for callers who ask one thing at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.operators import kg, state


@dataclass
class KnowledgeGraph:
    """Tables of a graph; reads give DataFrames, writes give a new graph and leave this one as it is."""

    entities: DataFrame
    triples: DataFrame
    aliases: DataFrame | None = None

    def query_entity(self, *names: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        probes = self.triples.sparkSession.createDataFrame([(n, as_of) for n in names], "entity string, as_of string")
        if self.aliases is not None:
            probes = kg.resolve_aliases(probes, "entity", self.aliases)
        return kg.query_entity(probes, self.triples, self.entities, direction)

    def query_relationship(self, predicate: str, as_of: str | None = None) -> DataFrame:
        return kg.query_relationship(self.triples, self.entities, predicate, as_of)

    def timeline(self, entity: str | None = None, limit: int = 100) -> DataFrame:
        return kg.timeline(self.triples, self.entities, entity, limit)

    def stats(self) -> DataFrame:
        return kg.stats(self.triples, self.entities)

    def list_entities(self, status: str = "active", kind: str | None = None) -> DataFrame:
        return kg.list_entities(self.entities, status, kind)

    def invalidate(self, closed: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(self.entities, state.invalidate(self.triples, closed), self.aliases)

    def delete(self, ids: DataFrame, ended: str) -> KnowledgeGraph:
        return KnowledgeGraph(*state.soft_delete(self.entities, self.triples, ids, ended), self.aliases)

    def merge(self, merges: DataFrame) -> KnowledgeGraph:
        e, t, a = state.merge_entities(self.entities, self.triples, merges)
        return KnowledgeGraph(e, t, a if self.aliases is None else self.aliases.select("alias", "canonical_id").unionByName(a))

    def register(self) -> None:
        """Temporary views entities, triples and aliases for SQL."""
        for name in ("entities", "triples", "aliases"):
            if (df := getattr(self, name)) is not None:
                df.createOrReplaceTempView(name)
