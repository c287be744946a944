"""Rule-based halls of sessions and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signals in the order in which they are tried.
PREFERENCE_SIGNALS = [
    "i prefer", "i usually", "i've been having trouble", "i've been feeling", "i've been struggling", "i want to", "i'm worried",
    "i've been thinking", "i've been considering", "lately i", "recently i", "i tend to",
]
ADVICE_SIGNALS = [
    "i suggest", "i recommend", "here are", "you might want to", "option 1", "option 2", "1.", "2.", "3.", "first,", "second,", "you could try",
    "i would recommend", "my recommendation",
]
EVENT_SIGNALS = [
    "milestone", "graduation", "promotion", "anniversary", "birthday", "moved", "started", "finished", "completed", "launched", "opened",
    "achieved", "won", "accepted", "hired", "married", "born",
]
FACT_SIGNALS = [
    "degree", "major", "university", "college", "job", "position", "role", "company", "city", "country", "street", "born in", "grew up",
    "studied", "works at", "lives in", "years old", "salary", "budget",
]
QUESTION_ASSISTANT = [
    "you suggested", "you told me", "you mentioned", "you said", "you recommended", "you provided", "you listed", "you gave",
    "remind me what you", "you came up with", "you explained",
]
QUESTION_PREFERENCE = [
    "i've been having trouble", "i've been feeling", "i prefer", "i usually", "battery", "nostalgic", "reunion", "lately", "recently been",
    "struggling with",
]
QUESTION_EVENT = [
    "milestone", "when did", "what happened", "achievement", "ago", "last week", "last month", "last year", "four weeks", "three months",
]
QUESTION_FACT = ["degree", "study", "graduate", "major", "job", "work", "live", "born", "city", "country", "company", "school"]


def _found(text: Column, signals: list[str]) -> Column:
    return sum((F.contains(text, F.lit(s)).cast("int") for s in signals), F.lit(0))


def session_hall(user_text: str | Column, assistant_text: str | Column) -> Column:
    """preferences, assistant, events, facts or general, the first rule that holds."""
    u = F.lower(F.col(user_text) if isinstance(user_text, str) else user_text)
    a = F.lower(F.col(assistant_text) if isinstance(assistant_text, str) else assistant_text)
    u, a = F.coalesce(u, F.lit("")), F.coalesce(a, F.lit(""))
    both = F.concat(u, a)
    return (
        F.when(_found(u, PREFERENCE_SIGNALS) > 0, "hall_preferences")
        .when(_found(a, ADVICE_SIGNALS) >= 2, "hall_assistant")
        .when(_found(both, EVENT_SIGNALS) > 0, "hall_events")
        .when(_found(both, FACT_SIGNALS) >= 2, "hall_facts")
        .otherwise("hall_general")
    )


def question_halls(question: str | Column) -> Column:
    """Halls that a question asks about, the likeliest first."""
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    halls = lambda *h: F.array(*(F.lit(f"hall_{x}") for x in h))
    return (
        F.when(_found(q, QUESTION_ASSISTANT) > 0, halls("assistant", "general"))
        .when(_found(q, QUESTION_PREFERENCE) > 0, halls("preferences", "general"))
        .when(_found(q, QUESTION_EVENT) > 0, halls("events", "facts", "general"))
        .when(_found(q, QUESTION_FACT) > 0, halls("facts", "general"))
        .otherwise(halls("general"))
    )
