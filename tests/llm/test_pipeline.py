from collections import Counter

import corpus_pipeline as C
from tessera.llm import registry
from tessera.llm.config_packing import cut_pieces

from . import test_jaccard, test_lines
from .conftest import ODD


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        kept = {r.doc_id: r for r in out.collect()}
        before = [(r.doc_id, r.text) for r in rows]
        if name == "lines":
            gone = test_lines.brute(before)
            for d, t in before:
                left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, []))
                assert (d in kept) == bool(left.strip()) and (d not in kept or kept[d].text == left)
        if name == "near_copies":
            want = test_jaccard.brute(before)
            assert set(kept) == {d for d, (_, c) in want.items() if d == c}
        rows = list(kept.values())
        docs = spark.createDataFrame(rows, docs.schema)
    packed = C.STAGES[-1][1](spark, docs, sf)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert Counter(map(key, packed.collect())) == Counter(map(key, cut_pieces(docs).collect()))
    assert Counter(map(key, C.run(spark, sf).collect())) == Counter(map(key, packed.collect()))


def odd_documents(spark):
    """Nulls, empties, texts that share an id, rows without an id, repeated rows, ties, a very long text, clashing extra columns."""
    words = [f"word{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [(100, " ".join(words), "en"), (101, near, "en"), (None, near, "en"), (None, " ".join(words), "en"), (100, "a text of its own under an id that is taken", "en"), (100, " ".join(words), "en"), (102, near, None)]
    return spark.createDataFrame([(*r, "s", 1, 7, "x", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_kept int, rid string, __own int")


def test_odd_rows_through_every_stage(spark, sf):
    docs = odd_documents(spark)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        key = lambda r: (r.doc_id, r.text)
        before, kept = Counter(map(key, docs.collect())), Counter(map(key, out.collect()))
        if name == "lines":
            assert sum(kept.values()) <= sum(before.values()) and any(d is None for d, _ in before)
        else:
            assert all(before[k] == n for k, n in kept.items()), name  # whole rows, repeats together
        if name == "near_copies":
            full, near = [t for d, t in before if d == 100 and t.startswith("word0")][0], [t for d, t in before if d == 101][0]
            assert kept[(100, full)] == 2 and kept[(None, near)] == 1 and kept[(None, full)] == 1 and (101, near) not in kept and (102, near) not in kept
            assert any(d == 100 and t.startswith("a text of its own") for d, t in kept)  # of no group
            assert all(kept[k] == n for k, n in before.items() if k[0] is None or not (k[1] or "").split())
        if name == "language":
            assert (0, None) not in kept and (1, "") not in kept and any(d is None for d, _ in kept)
        if name == "benchmark_leaks":
            assert kept == before
    assert C.STAGES[-1][1](spark, docs, sf).count() >= docs.count() - 1


def test_an_empty_table_through_every_stage(spark, sf):
    docs = odd_documents(spark).where("false")
    for name, stage in C.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_registry_has_one_query_for_each():
    numbers = [int(n[2:].split("_")[0]) for n in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
