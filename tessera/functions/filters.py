"""Metadata filters as trees, the form that vector stores take, made into columns.

A tree is a mapping or its JSON: ``{"field": value}`` or ``{"field": {"$gte": 1, "$lt": 5}}``, several fields at once
being a conjunction, and ``{"$and": [...]}``, ``{"$or": [...]}`` and ``{"$not": {...}}``.  What comes out is a plain
predicate, so that it is pushed into scans and runs before any ranking.

Missing values: a comparison with a null field is false, and so is everything but ``$ne`` and ``$nin``, which hold.
``{"field": null}`` asks for nulls.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tree = dict | str | None


def _is_in(c: Column, values: list) -> Column:
    rest = [v for v in values if v is not None]
    found = c.isin(rest) if rest else F.lit(False)
    return found | c.isNull() if len(rest) < len(values) else found


def _not_in(c: Column, values: list) -> Column:
    rest = [v for v in values if v is not None]
    other = ~c.isin(rest) if rest else F.lit(True)
    return c.isNotNull() & other if len(rest) < len(values) else c.isNull() | other


def _eq(c: Column, v) -> Column:
    return c.isNull() if v is None else c == F.lit(v)


#: Operators of one field: (column, value) to a predicate that may be null where the field is.
_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": _eq,
    "$ne": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: _is_in(c, list(v)),
    "$nin": lambda c, v: _not_in(c, list(v)),
    "$contains": lambda c, v: F.contains(c, F.lit(v)),
    "$not_contains": lambda c, v: c.isNull() | ~F.contains(c, F.lit(v)),
}


def parsed(tree: Tree) -> dict:
    """A tree from its JSON; null and blank text are the tree that lets all pass."""
    if isinstance(tree, str):
        tree = json.loads(tree) if tree.strip() else {}
    if tree is None:
        tree = {}
    if not isinstance(tree, dict):
        raise ValueError(f"a filter is a mapping, not {tree!r}")
    return tree


def fields(tree: Tree) -> set[str]:
    """Names of the fields that a tree mentions."""
    out: set[str] = set()
    for k, v in parsed(tree).items():
        if k in ("$and", "$or"):
            out |= set().union(*(fields(x) for x in v)) if v else set()
        elif k == "$not":
            out |= fields(v)
        else:
            out.add(k)
    return out


def _all(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def _field(name: str, wanted) -> Column:
    c = F.col(name)
    if not isinstance(wanted, dict):
        return _eq(c, wanted)
    unknown = set(wanted) - set(_OPERATORS)
    if unknown or not wanted:
        raise ValueError(f"{name}: {sorted(unknown) or 'no operator'}; there are {sorted(_OPERATORS)}")
    return _all(_OPERATORS[op](c, v) for op, v in wanted.items())


def where(tree: Tree) -> Column:
    """The predicate of a tree."""
    parts = []
    for k, v in parsed(tree).items():
        if k in ("$and", "$or"):
            if not isinstance(v, list) or not v:
                raise ValueError(f"{k} takes a list of one filter or more")
            each = [where(x) for x in v]
            if k == "$and":
                parts.append(_all(each))
            else:
                one = each[0]
                for x in each[1:]:
                    one = one | x
                parts.append(one)
        elif k == "$not":
            parts.append(~F.coalesce(where(v), F.lit(False)))
        elif k.startswith("$"):
            raise ValueError(f"no operator {k}")
        else:
            parts.append(_field(k, v))
    return _all(parts)


def filtered(df: DataFrame, tree: Tree) -> DataFrame:
    """Rows that pass; a field that isn't there is an error, not a filter that lets nothing pass."""
    missing = fields(tree) - set(df.columns)
    if missing:
        raise ValueError(f"no such fields: {sorted(missing)}")
    return df.where(where(tree)) if parsed(tree) else df


def scope(added_by: str | None = None, kind: str | None = None) -> dict:
    """The filter of a search: of one author, else of one kind, else none; never both."""
    return {"added_by": added_by} if added_by else {"kind": kind} if kind else {}
