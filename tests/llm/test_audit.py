import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tessera.llm.filter_audit import FILTERS, audit, lattice_edges, paths
from tessera.llm.oracles import AUDIT
from tests.llm.conftest import ODD


def brute(docs, labels):
    """(part, order, step) -> counts, by applying every order to every document."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    fails = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        }
        fails.append((lang or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        shapley = Counter()
        for order in map("".join, permutations(FILTERS)):
            for k, f in enumerate(order):
                row = Counter()
                for p, failed, g, x in fails:
                    if p == part:
                        before = bool(failed & set(order[:k]))
                        hit = f in failed
                        row.update(kept=not before and not hit, removed=not before and hit, redundant=before and hit, unique_fails=failed == {f}, good_lost=not before and hit and g, toxic_lost=not before and hit and x)
                shapley[f] += row["removed"]
                out[part, order, k + 1] = dict(row)
        for (p, order, k), row in out.items():
            if p == part:
                row["shapley"] = shapley[order[k - 1]]
    return out


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in df.collect()}


def test_paths_are_edges():
    assert len(paths()) == 600 and len({p[2:] for p in paths()}) == 80 and len({p[0] for p in paths()}) == 120


def test_edges(spark):
    counts = spark.createDataFrame([("p", 0b00101, True, False, 3), ("p", 0, False, False, 2)], "part string, fails int, good boolean, toxic boolean, n long")
    edges = {(r.applied, r.filter): r for r in lattice_edges(counts).collect()}
    assert len(edges) == 80 and all(not a >> f & 1 for a, f in edges)
    assert (edges[0, 0].removed, edges[0, 0].kept, edges[0, 0].good_lost) == (3, 2, 3)
    assert (edges[4, 0].removed, edges[4, 0].redundant, edges[4, 0].kept) == (0, 3, 2)
    assert (edges[0, 1].removed, edges[0, 1].kept) == (0, 5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0, "x"), (5, 1, 1, "x"), (5, 0, None, "x"), (6, None, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x"), (14, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_odd_rows(odd, labels):
    """Nulls, repeated rows, a row without an id, clashing columns, a very long text."""
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    got = as_dict(audit(odd, labels))
    assert got == brute(docs, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_large_group_of_copies(spark, labels):
    rows = [(i, "the same text" if i % 3 else f"text {i} $", "en") for i in range(300)] + [(None, "the same text", "en"), (2, "the same text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert as_dict(audit(docs, labels)) == brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_empty(empty, labels, odd):
    assert audit(empty, labels).count() == 0
    assert audit(odd, labels.where("false")).agg({"good_lost": "max"}).first()[0] == 0


def test_sql_of_odd_rows(odd, labels):
    """The SQL twin agrees where the driver's tables have no such rows."""
    documents, labels = odd.select("doc_id", "text", "lang").toPandas(), labels.drop("text").toPandas()  # noqa: F841  read by DuckDB
    got = duckdb.sql(AUDIT.replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, text, lang FROM documents)")).fetchall()
    want = brute([(None if d != d else d, t, x) for d, t, x in documents.itertuples(index=False)], [(None if d != d else d, None if q != q else q, None if t != t else t) for d, q, t in labels.itertuples(index=False)])
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == {k: (v["kept"], v["removed"], v["redundant"], v["unique_fails"], v["good_lost"], v["toxic_lost"], v["shapley"]) for k, v in want.items()}
    assert any(t == ODD[-1] for t in documents.text)
