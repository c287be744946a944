"""Text functions as column expressions, and the few that need Python as Arrow functions.

Word lists and patterns are parameters with the engine's fixed lists as defaults.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as X


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- names ----


_SPELLED = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "ł": "l", "Ł": "L", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."})


def folded(text: str | None) -> str | None:
    """ASCII form: decomposed, marks dropped, a few letters spelled out; what has no form is dropped."""
    return None if text is None else unicodedata.normalize("NFKD", text.translate(_SPELLED)).encode("ascii", "ignore").decode()


def fold_ascii(text: str | Column) -> Column:
    """``folded`` as an Arrow function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(folded)

    return run(_c(text))


def normalize_entity_name(name: str | Column, fold: bool = True) -> Column:
    """snake_case id: folded, CamelCase split, other signs as one underscore, one leading article dropped; `unknown` if empty."""
    c = F.trim(_c(name))
    if fold:
        c = fold_ascii(c)
    c = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")
    c = F.regexp_replace(F.regexp_replace(c, r"^_+|_+$", ""), r"^(the|a|an)_", "")
    return F.when(c == "", "unknown").otherwise(c)


def normalize_predicate(predicate: str | Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(_c(predicate))), r"[-\s]+", "_")
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")


def slugify(text: str | Column, most: int = 50) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(c, 1, most), "-+$", "")


def is_safe_name(name: str | Column) -> Column:
    """Letters, digits, blanks and ._- only, one to 128 characters, no path parts."""
    c = F.trim(_c(name))
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._'-]{0,127}$") & ~c.contains("..")


def record_id(agent: str | Column, source_file: str | Column, chunk_index: str | Column) -> Column:
    """record_{agent}_{24 hex digits of source and index}."""
    digest = F.sha2(F.concat(_c(source_file), _c(chunk_index).cast("string")), 256)
    return F.concat(F.lit("record_"), _c(agent), F.lit("_"), F.substring(digest, 1, 24))


def strip_turn(corpus_id: str | Column) -> Column:
    """Session id of a turn's id."""
    return F.regexp_replace(_c(corpus_id), r"_turn_\d+$", "")


# ---- summaries ----


def summary_text(what: str | Column, why: str | Column, scope: str | Column) -> Column:
    """`what -- why; scope`, without the parts that are missing."""
    blank = lambda c: F.nullif(F.trim(_c(c)), F.lit(""))
    head = F.concat_ws(" -- ", blank(what), blank(why))
    return F.concat_ws("; ", F.nullif(head, F.lit("")), blank(scope))


def summary_problem(what: str | Column, why: str | Column, scope: str | Column) -> Column:
    """Null if a summary is well formed, else its first problem."""
    n = lambda c: F.length(F.coalesce(F.trim(_c(c)), F.lit("")))
    return (
        F.when(n(what) < X.SUMMARY_WHAT_MIN, "what is too short")
        .when(n(why) < X.SUMMARY_WHY_MIN, "why is too short")
        .when(n(scope) > X.SUMMARY_SCOPE_MAX, "scope is too long")
        .when(F.length(summary_text(what, why, scope)) > X.SUMMARY_MAX, "summary is too long")
    )


def coerced_summary(what: str | Column, why: str | Column, scope: str | Column) -> Column:
    """Struct (what, why, scope, problem): the parts trimmed and in ASCII, or nulls and what is wrong with them; a blank scope is null."""
    clean = [fold_ascii(F.nullif(F.trim(_c(c)), F.lit(""))) for c in (what, why, scope)]
    problem = summary_problem(*clean)
    return F.struct(*(F.when(problem.isNull(), c).alias(k) for k, c in zip(("what", "why", "scope"), clean)), problem.alias("problem"))


def is_discriminative(what: str | Column, stoplist: list[str] = X.WHAT_STOPLIST, least: int = 8) -> Column:
    c = F.lower(F.trim(_c(what)))
    return (F.length(c) >= least) & ~c.isin(stoplist)


def preview(summary: str | Column, content: str | Column, most: int = X.PREVIEW_MAX) -> Column:
    """Summary, else content, on one line and cut with an ellipsis."""
    blank = lambda c: F.nullif(F.trim(_c(c)), F.lit(""))
    c = F.regexp_replace(F.coalesce(blank(summary), blank(content), F.lit("")), r"\s+", " ")
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


# ---- classification ----


def detect_content_type(text: str | Column, keywords: dict[str, list[str]] = X.CONTENT_TYPE_KEYWORDS) -> Column:
    """The type with most keywords in the first 3,000 characters; the earlier type wins ties; `fact` without any."""
    low = F.lower(F.substring(_c(text), 1, 3000))
    scores = {t: sum((low.contains(k).cast("int") for k in words), F.lit(0)) for t, words in keywords.items()}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit("fact")
    for t in reversed(scores):
        out = F.when((scores[t] == best) & (best > 0), t).otherwise(out)
    return out


def cues(pattern: str) -> list[str]:
    """Literals of which every match of a pattern holds one; none where the pattern isn't plain enough to tell."""
    if "(?" in pattern or re.search(r"\\[^\Wbdsw]", pattern):
        return []
    group = re.search(r"\(([^()\\]*)\)(?![?*{])", pattern)
    plain = re.sub(r"\([^()]*\)[?*]?", "\n", pattern)
    plain = re.sub(r"\\[bdsw][+*?]?|\[[^\]]+\][+*?]?|(?:\\\W|[^\\])[?*]|(?<!\\)[.+]", "\n", plain)
    if re.search(r"(?<!\\)[()|{}\[\]^$]", plain):
        return []
    best = max(re.sub(r"\\(\W)", r"\1", plain).split("\n"), key=len)
    if len(best) < 3 and group:
        each = [cues(pattern[: group.start()] + x + pattern[group.end() :]) for x in group[1].split("|")]
        if all(each):
            return [c for x in each for c in x]
    return [best] if best else []


def marker_score(text: str | Column, markers: list[str], lowered: bool = False) -> Column:
    """Number of matches of all patterns in the lower-cased text; ``lowered`` says that it is already, so that only patterns whose cues it holds are searched for."""
    low = _c(text) if lowered else F.lower(_c(text))

    def count(pattern: str) -> Column:
        found, held = F.regexp_count(low, F.lit(pattern)), [low.contains(c) for c in cues(pattern)]
        return F.when(~reduce(or_, held), 0).otherwise(found) if lowered and held else found

    return sum(map(count, markers), F.lit(0))


def sentiment(text: str | Column, positive: list[str] = X.POSITIVE_WORDS, negative: list[str] = X.NEGATIVE_WORDS) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))
    p = F.size(F.array_intersect(words, F.lit(positive)))
    n = F.size(F.array_intersect(words, F.lit(negative)))
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def has_resolution(text: str | Column, patterns: list[str] = X.RESOLUTION_PATTERNS) -> Column:
    return F.lower(_c(text)).rlike("|".join(f"(?:{p})" for p in patterns))


def is_code_line(line: str | Column, patterns: list[str] = X.CODE_LINE_PATTERNS) -> Column:
    """A pattern of code, or over 10 characters of which fewer than 0.4 are letters."""
    c = F.trim(_c(line))
    few = (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) < 0.4 * F.length(c)) & (F.length(c) > 10)
    return (c != "") & (c.rlike("|".join(f"(?:{p})" for p in patterns)) | few)


def extract_prose(text: str | Column) -> Column:
    """Lines outside fences that aren't code; the text itself if none is left."""
    lines = F.split(_c(text), "\n")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(s, line):
        fence = F.startswith(F.trim(line), F.lit("```"))
        keep = ~fence & ~s["inside"] & ~is_code_line(line)
        return F.struct((s["inside"] != fence).alias("inside"), F.when(keep, F.concat(s["kept"], F.array(line))).otherwise(s["kept"]).alias("kept"))

    prose = F.trim(F.array_join(F.aggregate(lines, start, step)["kept"], "\n"))
    return F.when(prose != "", prose).otherwise(_c(text))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for a row, however often they are used after.

    Projections and filters over plain columns are merged, and with them what they compute; rows made by a generator aren't.
    """
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("__once"))
    return made.select(*df.columns, *(F.col(f"__once.{k}").alias(k) for k in columns))


def memory_types(df: DataFrame, text: str = "text", least: float = 0.3, markers: dict[str, list[str]] = X.MARKERS) -> DataFrame:
    """Segments with memory_type and confidence; those too short, without a marker or below ``least`` are left out."""
    own = df.columns
    df = once(df.where(F.length(F.trim(text)) >= 20), __prose=extract_prose(text))
    df = once(df, __low=F.lower("__prose"))
    df = once(df, **{f"__{k}": marker_score("__low", m, lowered=True) for k, m in markers.items()})
    score = {k: F.col(f"__{k}") for k in markers}
    best = F.greatest(*score.values())
    bonus = F.when(F.length(text) > 500, 2).when(F.length(text) > 200, 1).otherwise(0)
    confidence = F.least(F.lit(1.0), (best + bonus) / 5.0)
    kind = F.lit(None).cast("string")
    for k in reversed(score):
        kind = F.when(score[k] == best, k).otherwise(kind)
    df = df.where((best > 0) & (confidence >= least)).select("*", kind.alias("__kind"), confidence.alias("confidence"))
    problem = F.col("__kind") == "problem"  # only these may turn out to be something else
    df = once(df, __good=F.when(problem, sentiment("__prose") == "positive"), __solved=F.when(problem, has_resolution("__prose")))
    good, solved = F.col("__good"), F.col("__solved")
    kind = (
        F.when(problem & solved & (score["emotional"] > 0) & good, "emotional")
        .when(problem & solved, "milestone")
        .when(problem & good & (score["milestone"] > 0), "milestone")
        .when(problem & good & (score["emotional"] > 0), "emotional")
        .otherwise(F.col("__kind"))
    )
    return df.select(*own, kind.alias("memory_type"), "confidence")


def extract_memories(df: DataFrame, key: str, text: str = "text", least: float = 0.3) -> DataFrame:
    """(key, chunk_index, content, memory_type, confidence): the segments of each text that are memories, numbered in order."""
    from tessera.functions.segments import segments, stripped

    found = memory_types(segments(df.select(key, text), text), "content", least)
    w = Window.partitionBy(key).orderBy("segment_index")
    return found.select(key, (F.row_number().over(w) - 1).alias("chunk_index"), stripped("content").alias("content"), "memory_type", "confidence")


# ---- queries ----


def prompt_keywords(text: str | Column, limit: int = 8, stop: list[str] = X.PROMPT_STOPWORDS) -> Column:
    """First distinct tokens of three characters and more that aren't stop words."""
    tokens = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[a-zA-Z][a-zA-Z0-9\-]{2,}"), F.lit(0))
    return F.slice(F.filter(F.array_distinct(tokens), lambda x: ~x.isin(stop)), 1, limit)


def sanitize_query(text: str | Column, safe: int = 200, most: int = 500, least: int = 10) -> Column:
    """Struct (clean_query, method): short queries pass; else the last line or sentence with a question, the last long line, or the tail."""
    t = F.trim(_c(text))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    asks = F.filter(lines, lambda x: x.rlike(r"[?？]\s*[\"']?\s*$"))
    sentences = F.filter(F.transform(F.split(t, r"[.!?。！？\n]+"), lambda x: F.trim(x)), lambda x: x.rlike("[?？]"))
    ask = F.coalesce(F.try_element_at(asks, F.lit(-1)), F.try_element_at(sentences, F.lit(-1)))
    tail = lambda c: F.when(F.length(c) > most, F.substring(c, -most, most)).otherwise(c)
    long = F.try_element_at(F.filter(lines, lambda x: F.length(x) >= least), F.lit(-1))
    out = lambda c, m: F.struct(c.alias("clean_query"), F.lit(m).alias("method"))
    return (
        F.when(t.isNull() | (F.length(t) <= safe), out(F.coalesce(t, F.lit("")), "passthrough"))
        .when(F.length(ask) >= least, out(tail(ask), "question_extraction"))
        .when(long.isNotNull(), out(tail(long), "tail_sentence"))
        .otherwise(out(F.trim(tail(t)), "tail_truncation"))
    )


def query_keywords(text: str | Column, stop: list[str] = X.QUERY_STOPWORDS) -> Column:
    tokens = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[a-z]{3,}"), F.lit(0))
    return F.filter(tokens, lambda x: ~x.isin(stop))


def keyword_overlap(keywords: str | Column, text: str | Column) -> Column:
    """Share of keywords that the text contains; 0 without keywords."""
    k, low = _c(keywords), F.lower(_c(text))
    return F.when(F.size(k) > 0, F.size(F.filter(k, lambda x: F.contains(low, x))) / F.size(k)).otherwise(0.0)


def quoted_phrases(text: str | Column) -> Column:
    """Phrases of 3 to 60 characters within single or double quotes."""
    t = _c(text)
    return F.concat(F.regexp_extract_all(t, F.lit("'([^']{3,60})'"), F.lit(1)), F.regexp_extract_all(t, F.lit('"([^"]{3,60})"'), F.lit(1)))


def phrase_boost(phrases: str | Column, text: str | Column) -> Column:
    return keyword_overlap(F.transform(_c(phrases), lambda x: F.lower(x)), text)


def person_names(text: str | Column, not_names: list[str] = X.NOT_NAMES) -> Column:
    """Distinct capitalised words of three letters and more that aren't among ``not_names``."""
    words = F.regexp_extract_all(_c(text), F.lit(r"\b[A-Z][a-z]{2,15}\b"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda x: ~x.isin(not_names))


def normalize_answer(text: str | Column) -> Column:
    c = F.regexp_replace(F.lower(F.replace(_c(text), F.lit(","), F.lit(""))), r"\b(a|an|the|and)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\s_]", ""), r"\s+", " "))


def token_f1(prediction: str | Column, truth: str | Column) -> Column:
    """F1 of the multisets of tokens after normalising; 0 if nothing is shared."""
    split = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda x: x != "")
    p, t = split(prediction), split(truth)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    same = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, x: s + F.least(count(p, x), count(t, x)))
    precision, recall = same / F.size(p), same / F.size(t)
    return F.when(same == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def bounded_correction(word: str | Column, candidate: str | Column) -> Column:
    """A correction if it is within 2 edits (3 for words over 7 letters), else the word."""
    w, c = _c(word), _c(candidate)
    return F.when(c.isNotNull() & (F.levenshtein(w, c) <= F.when(F.length(w) <= 7, 2).otherwise(3)), c).otherwise(w)


def skip_spelling(token: str | Column) -> Column:
    """Tokens that aren't corrected: short, with digits, CamelCase, ALL CAPS, technical, addresses, marked up."""
    t = _c(token)
    return (
        (F.length(t) < 4) | t.rlike(r"\d") | t.rlike(r"[A-Z][a-z]+[A-Z]") | t.rlike(r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$") | t.rlike("[-_]")
        | t.rlike(r"^(https?://|www\.|/Users/|~/|\.[a-z]{2,4}$)") | t.rlike(r"[`*_#{}\[\]\\]")
    )


# ---- relative dates ----


def relative_days(text: str | Column, phrases: list[tuple[str, str, int]] = X.RELATIVE_DATES) -> Column:
    """Struct (days, tolerance) of the first phrase of time that the text holds, or null."""
    low = F.lower(_c(text))
    out = F.lit(None).cast("struct<days:int,tolerance:int>")
    for pattern, days, tolerance in reversed(phrases):
        if days.startswith("*"):
            n = F.regexp_extract(low, pattern, 1).try_cast("int") * int(days[1:])
        else:
            n = F.lit(int(days))
        out = F.when(low.rlike(pattern), F.struct(n.alias("days"), F.lit(tolerance).alias("tolerance"))).otherwise(out)
    return out


def temporal_boost(age: str | Column, days: str | Column, tolerance: str | Column, most: float = 0.40) -> Column:
    """Full within the tolerance around the target, falling to 0 at three times the tolerance."""
    off = F.abs(_c(age) - _c(days))
    t = _c(tolerance).cast("double")
    fall = most * (1 - (off - t) / (2 * t))
    return F.coalesce(F.when(off <= t, F.lit(most)).when(off <= 3 * t, fall).otherwise(0.0), F.lit(0.0))


def preferences(text: str | Column, patterns: list[str] = X.PREFERENCE_PATTERNS, most: int = 12) -> Column:
    """Distinct mentions of 5 to 80 characters in order of the patterns, the first ``most``."""
    low = F.lower(_c(text))
    found = F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns)))
    clean = F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"[.,;:!?\s]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x).between(5, 80))), 1, most)


def preference_document(mentions: str | Column) -> Column:
    m = _c(mentions)
    return F.when(F.size(m) > 0, F.concat(F.lit("User has mentioned: "), F.array_join(m, "; ")))


def extract_content(value: str | Column) -> Column:
    """Text of a message's content given as JSON: a string, a list of strings or {text} blocks, or one block."""
    v = F.try_parse_json(_c(value))
    kind = F.schema_of_variant(v)
    one = F.try_variant_get(v, "$", "string")
    parts = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    return F.trim(
        F.when(v.isNull(), _c(value))
        .when(kind == "STRING", one)
        .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(texts, " "))
        .otherwise(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))
    )
