"""Pieces around retrieval: views, gates, juries, gardening, layers and labelled pairs.

Models are plain functions to pass in; the defaults keep all and decide nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scoring import power_law_decay, sigmoid, wake_up_score
from tessera.operators.ranking import adaptive_k, top_k, within_budget

# ---- views ----


def explode_views(entities: DataFrame) -> DataFrame:
    """(owner_id, view_index, view_id, text, is_summary_view) of entities (id, queries, summary): one row for each query, the summary last."""
    v = F.when(F.coalesce("summary", F.lit("")) != "", F.array_append("queries", F.col("summary"))).otherwise(F.col("queries"))
    rows = entities.select(F.col("id").alias("owner_id"), F.size("queries").alias("n"), F.posexplode(v).alias("view_index", "text"))
    return rows.select("owner_id", "view_index", F.concat("owner_id", F.lit("__v"), "view_index").alias("view_id"), "text", (F.col("view_index") == F.col("n")).alias("is_summary_view"))


def three_levels(entities: DataFrame) -> DataFrame:
    """Abstract, identity and probe views of entities (id, what, why, scope, probes)."""
    row = lambda kind, vid, text: F.struct(F.lit(kind).alias("view_kind"), vid.alias("view_id"), text.alias("text"))
    probes = F.transform("probes", lambda x, i: row("probe", F.concat(F.col("id"), F.lit("__v"), i.cast("string")), x))
    all_ = F.concat(F.array(row("abstract", F.col("id"), T.summary_text("what", "why", "scope")), row("identity", F.concat("id", F.lit("__identity")), F.col("what"))), probes)
    return entities.select(F.col("id").alias("owner_id"), F.inline(all_))


def missing_summary_views(entities: DataFrame, views: DataFrame) -> DataFrame:
    """Entities with a summary and no summary view."""
    have = views.where("is_summary_view").select(F.col("owner_id").alias("id")).distinct()
    return entities.where(F.coalesce("summary", F.lit("")) != "").join(have, "id", "left_anti")


def without_pollution(contexts: DataFrame, linked: DataFrame, intent: str = r"^(intent|ctx)_[a-z0-9_]+$") -> DataFrame:
    """Contexts (id, queries) without queries that equal a linked entity's content (context_id, content; 200 characters) or name an intent."""
    c = linked.groupBy(F.col("context_id").alias("id")).agg(F.collect_set(F.substring("content", 1, 200)).alias("__c"))
    out = contexts.join(c, "id", "left")
    none = F.array().cast("array<string>")
    keep = F.filter("queries", lambda q: ~F.array_contains(F.coalesce("__c", none), F.substring(q, 1, 200)) & ~q.rlike(intent))
    return out.withColumn("queries", keep).drop("__c")


def similar_edges(edges: DataFrame, fresh: DataFrame, least: float = 0.65, ended: str = "") -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, confidence) with recomputed similarity (a, b, similarity): those that stay, and those to close."""
    e = edges.drop("confidence").join(fresh, ["a", "b"]).withColumnRenamed("similarity", "confidence")
    return e.where(F.col("confidence") >= least), e.where(F.col("confidence") < least).withColumn("valid_to", F.lit(ended))


# ---- gates and juries ----


def gate(results: DataFrame, judge: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Results (query_id, id, text, rank) with ``keep`` and ``failure``; ``judge`` sees one query's rows.

    Without a judge all stay; if it fails all of that query's rows stay too, and ``failure`` says why, so that failures can be counted.
    """
    if judge is None:
        return results.withColumn("keep", F.lit(True)).withColumn("failure", F.lit(None).cast("string"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            keep, failure = judge(pdf).astype(bool).to_numpy(), None
        except Exception as e:  # noqa: BLE001  a judge that fails drops nothing
            keep, failure = True, f"{type(e).__name__}: {e}"[:200]
        return pdf.assign(keep=keep, failure=failure)

    schema = ", ".join(f"`{c}` {t}" for c, t in results.dtypes) + ", keep boolean, failure string"
    return results.groupBy("query_id").applyInPandas(run, schema)


def parse_decisions(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, id, keep) from a model's replies (query_id, reply): the first decision on a known id counts, malformed replies give none."""
    d = F.from_json("reply", "decisions array<struct<id:string,action:string>>")
    each = replies.select("query_id", F.posexplode(d["decisions"]).alias("pos", "d")).select("query_id", "pos", "d.id", (F.col("d.action") == "keep").alias("keep"))
    each = each.where("keep IS NOT NULL").join(known.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    w = Window.partitionBy("query_id", "id").orderBy("pos")
    return each.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "id", "keep")


def drops_as_feedback(results: DataFrame, ts: str) -> DataFrame:
    """What a gate dropped, as ratings of relevance 2."""
    return results.where("NOT keep").select(F.col("query_id").alias("context_id"), F.col("id").alias("memory_id"), F.lit(2).alias("relevance"), F.lit(ts).alias("ts"))


def weak_reasons(feedback: DataFrame, patterns: list[str], similarity: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """Ratings with ``weak``: the reason matches a pattern, or is near an exemplar (id, similarity)."""
    hit = F.lower("reason").rlike("|".join(f"(?:{p})" for p in patterns))
    if similarity is None:
        return feedback.withColumn("weak", F.coalesce(hit, F.lit(False)))
    s = similarity.groupBy("id").agg(F.max("similarity").alias("__s"))
    return feedback.join(s, "id", "left").withColumn("weak", F.coalesce(hit, F.lit(False)) | F.coalesce(F.col("__s") >= threshold, F.lit(False))).drop("__s")


def jury(candidates: DataFrame, juror: Callable[[dict], str] | None = None) -> DataFrame:
    """Candidates with a verdict; `uncertain` without a juror."""
    if juror is None:
        return candidates.withColumn("verdict", F.lit("uncertain"))
    names = candidates.columns

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([juror(dict(zip(names, r))) for r in rows.itertuples(index=False)])

    return candidates.withColumn("verdict", run(F.struct(*names)))


def persist_verdicts(judged: DataFrame, confidence: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Processed candidates, and the edges that were accepted (verdict `edge:<predicate>`)."""
    p = F.regexp_extract("verdict", "^edge:(.+)$", 1)
    edges = judged.where(p != "").select(F.col("from_entity").alias("subject"), p.alias("predicate"), F.col("to_entity").alias("object"), F.lit(confidence).alias("confidence"))
    return judged, edges


def domain_hint(pairs: DataFrame, contexts: DataFrame, recent: int = 5, queries: int = 2, keywords: int = 5) -> DataFrame:
    """For pairs (pair_id, context_id): of their latest contexts (context_id, ts, queries, keywords) a few queries and keywords."""
    j = top_k(pairs.join(contexts, "context_id"), ["pair_id"], [F.desc("ts"), "context_id"], recent)
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])))
    return j.groupBy("pair_id").agg(F.slice(flat("queries"), 1, queries).alias("queries"), F.slice(flat("keywords"), 1, keywords).alias("keywords"))


#: What a gardener's outcome resolves a flag to, and its counter.
OUTCOMES = {"merged": "merged", "invalidated": "invalidated", "edited": "edited_summary", "linked": "linked_edge", "deferred": "deferred", "none": "no_action"}


def gardener_counters(trace: DataFrame) -> DataFrame:
    """One row of counters from a run's outcomes (flag_id, outcome); the last outcome of a flag counts, by pos."""
    last = trace.groupBy("flag_id").agg(F.max_by("outcome", "pos").alias("outcome"))
    return last.agg(*(F.count_if(F.col("outcome") == k).alias(v) for k, v in OUTCOMES.items()), F.count("*").alias("flags"))


# ---- layers ----


def layer_one(records: DataFrame, by: str = "agent", snippet: int = 200, budget: int = 3200, max_k: int = 15, min_k: int = 3) -> DataFrame:
    """Wake-up rows of each agent: by importance and freshness, cut at the largest gap, in snippets within a budget of characters."""
    s = records.dropDuplicates([by, "id"]).withColumn("score", F.round(wake_up_score("importance", power_law_decay("age", "importance")), 9))
    kept = adaptive_k(s, [by], "score", "id", max_k, min_k).withColumn("snippet", F.substring("text", 1, snippet))
    return within_budget(kept, [by], [F.desc("score"), "id"], F.length("snippet"), budget)


def layer_zero(agents: DataFrame, triples: DataFrame, records: DataFrame, most: int = 500) -> DataFrame:
    """Identity text of each agent: records that it is described by."""
    t = triples.where("predicate = 'described_by' AND valid_to IS NULL").select(F.col("subject").alias("agent"), F.col("object").alias("id"))
    j = agents.select("agent").join(t, "agent").join(records.select("id", F.substring("text", 1, most).alias("snippet")), "id")
    return j.groupBy("agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "snippet"))), lambda x: x["snippet"]), "\n").alias("identity"))


def stack_status(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.coalesce(F.floor(F.sum(F.length("text")) / 4), F.lit(0)).alias("tokens"))


def pair_scores(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | None = None, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """Pairs (query_id, id, query, text) by a cross-encoder's logits, through the sigmoid, over a threshold, the best of each query.

    The default scorer is lexical: words shared over words of the query, as a logit.
    """

    def lexical(a: list[str], b: list[str]) -> list[float]:
        import math

        out = []
        for q, t in zip(a, b):
            w = set((q or "").lower().split())
            p = len(w & set((t or "").lower().split())) / max(1, len(w))
            p = min(max(p, 1e-6), 1 - 1e-6)
            out.append(math.log(p / (1 - p)))
        return out

    score = scorer or lexical

    @F.pandas_udf("double")
    def logit(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), t.tolist()))

    s = pairs.withColumn("score", F.round(sigmoid(logit("query", "text")), 9)).where(F.col("score") >= threshold)
    return top_k(s, ["query_id"], [F.desc("score"), "id"], limit)


def labelled_pairs(rated: DataFrame, contexts: DataFrame, memories: DataFrame, only_current: bool = True, least: int = 0) -> DataFrame:
    """Rated edges with the queries of their context and the text of their memory; contexts with fewer than ``least`` pairs are left out."""
    r = rated.where("valid_to IS NULL") if only_current else rated
    j = r.join(contexts.select("context_id", "queries"), "context_id").join(memories.select(F.col("id").alias("memory_id"), F.col("text").alias("memory_content")), "memory_id")
    j = j.withColumn("__n", F.count("*").over(Window.partitionBy("context_id"))).where(F.col("__n") >= least).drop("__n")
    return j.withColumn("label", (F.col("relevance") >= 3).cast("int")).withColumn("content_length", F.length("memory_content"))


def facts_to_triples(facts: DataFrame) -> DataFrame:
    """Facts of people (name, type, partner, parents, interests) as triples, exploded from the nested row."""
    name = F.col("name")
    t = lambda p, o: F.struct(name.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    none = F.array().cast("array<string>")
    all_ = F.concat(
        F.array(t("is_a", F.col("type")), t("partner_of", F.col("partner"))), F.transform(F.coalesce("parents", none), lambda x: t("child_of", x)), F.transform(F.coalesce("interests", none), lambda x: t("loves", x))
    )
    return facts.select(F.inline(F.filter(all_, lambda x: x["object"].isNotNull())))


def pivot_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key-value metadata (id, key, value) as one row for each id."""
    return rows.groupBy("id").pivot("key", keys).agg(F.first("value"))


def attach_state(hits: DataFrame, triples: DataFrame, bearing: DataFrame, latest: DataFrame) -> DataFrame:
    """Hits with the payload of entities whose class bears state (class_id)."""
    c = triples.where("predicate = 'is_a' AND valid_to IS NULL").join(bearing.select(F.col("class_id").alias("object")), "object", "left_semi").select(F.col("subject").alias("id")).distinct()
    s = latest.select(F.col("entity_id").alias("id"), "payload").join(c, "id", "left_semi")
    return hits.join(s, "id", "left")


def state_classes(entities: DataFrame) -> DataFrame:
    """Classes whose properties say that they bear state."""
    return entities.where(F.get_json_object("properties", "$.state_updatable") == "true").select(F.col("id").alias("class_id"))


def apply_patch(payload: str, patch: str) -> str | None:
    """A JSON patch (add, replace, remove, copy, move, test) applied to a payload; null if any step fails."""
    import copy
    import json

    def walk(doc, pointer):
        keys = [k.replace("~1", "/").replace("~0", "~") for k in pointer.split("/")[1:]]
        for k in keys[:-1]:
            doc = doc[int(k)] if isinstance(doc, list) else doc[k]
        return doc, keys[-1]

    def get(doc, pointer):
        parent, k = walk(doc, pointer)
        return parent[int(k)] if isinstance(parent, list) else parent[k]

    def put(doc, pointer, value, replace=False):
        parent, k = walk(doc, pointer)
        if isinstance(parent, list):
            at = len(parent) if k == "-" else int(k)
            if at > len(parent) or replace and at == len(parent):
                raise IndexError(pointer)
            parent[at : at + replace] = [value]
        else:
            if replace and k not in parent:
                raise KeyError(pointer)
            parent[k] = value

    def drop(doc, pointer):
        parent, k = walk(doc, pointer)
        return parent.pop(int(k) if isinstance(parent, list) else k)

    try:
        doc = json.loads(payload)
        for step in json.loads(patch):
            op, path = step["op"], step["path"]
            if op in ("add", "replace"):
                put(doc, path, step["value"], op == "replace")
            elif op == "remove":
                drop(doc, path)
            elif op == "move":
                put(doc, path, drop(doc, step["from"]))
            elif op == "copy":
                put(doc, path, copy.deepcopy(get(doc, step["from"])))
            elif op != "test" or get(doc, path) != step["value"]:
                return None
    except (KeyError, IndexError, ValueError, TypeError, AttributeError):
        return None
    return json.dumps(doc, separators=(",", ":"))


def patched(payload: str, patch: str) -> F.Column:
    """``apply_patch`` as an Arrow function over two columns."""

    @F.pandas_udf("string")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else apply_patch(a, b) for a, b in zip(p, q)])

    return run(payload, patch)
