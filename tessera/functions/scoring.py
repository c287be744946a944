"""Scoring as column expressions: decay, hybrid scores, cosine, IDF, damping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring model.
STABILITY_DAYS = {5: 365.0, 4: 90.0, 3: 30.0, 2: 7.0, 1: 1.0}
OTHER_STABILITY = 30.0
DECAY_WEIGHT = 0.2
SEARCH_WEIGHTS = {"sim": 0.45, "rel": 0.18, "imp": 0.25, "decay": 0.12}
CHANNEL_WEIGHTS = {"cosine": 1.0, "graph": 0.7, "keyword": 0.8, "context": 1.5}
SESSION_BOOST, INTENT_BOOST = 0.08, 0.05
TIER, L1_DECAY, L1_AGENT, L1_SESSION, L1_INTENT = 10.0, 2.5, 0.5, 0.3, 0.2
UNKNOWN_AGE = 365.0


def _c(x: str | Column | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def parsed_time(iso: str | Column) -> Column:
    """Timestamp of an ISO string, with or without a time, fraction or trailing Z; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(_c(iso), "T", " "), "Z$", ""))


def age_days(date_iso: str | Column, last_relevant_iso: str | Column | None, now: str | Column) -> Column:
    """Days from the latest anchor (last relevant, else date) to ``now``; 365 if it can't be read, 0 at least."""
    anchor = _c(date_iso) if last_relevant_iso is None else F.coalesce(F.nullif(_c(last_relevant_iso), F.lit("")), _c(date_iso))
    now = parsed_time(F.lit(now) if isinstance(now, str) else now)
    days = (now.cast("double") - parsed_time(anchor).cast("double")) / 86400.0
    return F.when(days.isNull(), UNKNOWN_AGE).otherwise(F.greatest(days, F.lit(0.0)))


def power_law_decay(age: str | Column, importance: str | Column) -> Column:
    """Penalty from 0 (fresh) to -0.2 (old); important things age slower."""
    whole = _c(importance).cast("int")
    stability = F.lit(OTHER_STABILITY)
    for k, v in STABILITY_DAYS.items():
        stability = F.when(whole == k, F.lit(v)).otherwise(stability)
    return -F.lit(DECAY_WEIGHT) * (1.0 - F.pow(1.0 + _c(age) / stability, F.lit(-0.5)))


def hybrid_score(
    similarity, importance, decay, relevance=0.0, session_match=None, intent_match=None, weights: dict[str, float] | None = None
) -> Column:
    """Search mode: weighted similarity, signed relevance, importance and freshness, plus affinity boosts."""
    w = SEARCH_WEIGHTS | (weights or {})
    imp = F.coalesce(F.nullif(_c(importance).cast("double"), F.lit(0.0)), F.lit(3.0))
    boost = F.lit(0.0)
    if session_match is not None:
        boost += F.when(_c(session_match), SESSION_BOOST).otherwise(0.0)
    if intent_match is not None:
        boost += F.when(_c(intent_match), INTENT_BOOST).otherwise(0.0)
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_c(similarity), F.lit(0.0))))
    rel = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(_c(relevance), F.lit(0.0))))
    return w["sim"] * sim + w["rel"] * rel + w["imp"] * (imp - 1.0) / 4.0 + w["decay"] * (1.0 + _c(decay) / DECAY_WEIGHT) + boost


def wake_up_score(importance, decay, agent_match=None, session_match=None, intent_match=None) -> Column:
    """Importance-first mode: a higher tier always wins."""
    out = _c(importance).cast("double") * TIER + _c(decay) * L1_DECAY
    for match, boost in ((agent_match, L1_AGENT), (session_match, L1_SESSION), (intent_match, L1_INTENT)):
        if match is not None:
            out += F.when(_c(match), boost).otherwise(0.0)
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; 0 if lengths differ or one is all zero."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms).otherwise(0.0)


def idf(n: str | Column, freq: str | Column) -> Column:
    """ln(max(0, (n - f + 0.5) / (f + 0.5)) + 1)."""
    n, f = _c(n), _c(freq)
    return F.log(F.greatest(F.lit(0.0), (n - f + 0.5) / (f + 0.5)) + 1.0)


def sigmoid(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def degree_damping(degree: str | Column) -> Column:
    return 1.0 / F.log(_c(degree) + 2.0)


def learning_features(relevance, importance, age) -> Column:
    """Struct of features between 0 and 1 for learning weights; similarity is fixed at 0."""
    return F.struct(
        F.lit(0.0).alias("sim"), ((_c(relevance) + 1.0) / 2.0).alias("rel"), ((_c(importance) - 1.0) / 4.0).alias("imp"),
        (1.0 / (1.0 + _c(age) / 30.0)).alias("decay"),
    )


def time_window_boost(ts: str | Column, start, end, boost: float = 0.15) -> Column:
    """A boost, not a filter: inside [start, end], or from one bound if the other is null."""
    ts, start, end = _c(ts), _c(start), _c(end)
    given = start.isNotNull() | end.isNotNull()
    inside = (start.isNull() | (ts >= start)) & (end.isNull() | (ts <= end))
    return F.when(given & inside, boost).otherwise(0.0)
