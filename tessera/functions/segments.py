"""Texts as segments: speaker turns where there are enough of them, else paragraphs, else groups of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns from which a text is a dialogue, lines of a group, and lines beyond which a single block is cut.
LEAST_TURNS, GROUP, MOST_LINES = 3, 25, 20
#: A line that opens a turn: a quoted one, or a speaker's name.
TURN = r"[^\S\n]*(?:>[^\S\n]+[^\s]|(?:human|user|q|assistant|ai|a|claude|chatgpt)[^\S\n]*:)"
_LINE = "(?mdiU)^"


def stripped(text: str | Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def turns(text: Column) -> Column:
    """Pieces that begin at a line that opens a turn, and what stands before the first."""
    parts = F.split(text, f"{_LINE}(?={TURN})")
    last = F.size(parts) - 1
    return F.transform(parts, lambda p, i: F.when(i < last, F.regexp_replace(p, r"\n\z", "")).otherwise(p))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")


def line_groups(text: Column) -> Column:
    lines = F.split(text, "\n")
    groups = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(GROUP)), lambda i: stripped(F.array_join(F.slice(lines, i + 1, GROUP), "\n")))
    return F.filter(groups, lambda p: p != "")


def segments_of(text: str | Column) -> Column:
    """The segments of a text in order; null and blank texts have none."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n_turns = F.regexp_count(c, F.lit(_LINE + TURN))
    n_lines = F.size(F.split(c, "\n"))
    own = paragraphs(c)
    blocks = F.when((F.size(own) <= 1) & (n_lines > MOST_LINES), line_groups(c)).otherwise(own)
    return F.filter(F.when(n_turns >= LEAST_TURNS, turns(c)).otherwise(blocks), lambda p: stripped(p) != "")


def segments(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each segment: the columns of ``df`` but the text, then segment_index and content."""
    own = [c for c in df.columns if c != text]
    return df.select(*own, F.posexplode(segments_of(text)).alias("segment_index", "content"))
