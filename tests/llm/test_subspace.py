import math

import numpy as np
import pytest

from tessera.llm import subspace_join as S

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, key long"


def brute(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) of each row by comparing all pairs in double precision."""
    n = len(rows)
    vectors = [None if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, np.float32).astype(np.float64) for _, v, *_ in rows]
    up, links = list(range(n)), [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            u, v = vectors[i], vectors[j]
            if u is None or v is None or len(u) != len(v) or rows[i][2] is None or rows[i][2] != rows[j][2]:
                continue
            if (u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum())) >= least:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[root(i)] = min(least_id.get(root(i), r[0]), r[0])
    return sorted(((r[0], links[i], least_id.get(root(i)), None if r[0] is None else r[0] == least_id[root(i)]) for i, r in enumerate(rows)), key=repr)


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(n, d, seed=0, labels=3):
    """Random vectors, some of them at all similarities around the threshold to others."""
    r = np.random.default_rng(seed)
    out = [r.standard_normal(d) for _ in range(n)]
    for k in range(n):
        base = out[int(r.integers(len(out)))]
        unit = base / np.linalg.norm(base)
        off = r.standard_normal(d)
        off -= off @ unit * unit
        c = float(r.choice([0.90, 0.925, 0.929, 0.931, 0.935, 0.95, 0.99]))
        out.append((c * unit + math.sqrt(1 - c * c) * off / np.linalg.norm(off)) * float(r.uniform(0.1, 9)))
    lab = [int(r.integers(labels)) for _ in range(n)] * 2
    return [(i, v.astype(np.float32).tolist(), lab[i], "x", 7) for i, v in enumerate(out)]


@pytest.mark.parametrize("bits", [0, 3, 7])
def test_visits_lose_no_pair(bits):
    """Of any two rows within the budget, the one of the lower cell visits the other's."""
    r = np.random.default_rng(bits)
    x = r.standard_normal((300, 8)) * 0.1
    x = np.concatenate([x, x + r.standard_normal((300, 8)) * 0.03])
    own, row, cell = S.visits(x, bits, 0.02)
    seen = set(zip(row.tolist(), cell.tolist()))
    assert len(seen) == len(row) and (cell > own[row]).all()
    near = np.argwhere(S.squared(x, x) <= 0.02)
    assert any(own[i] != own[j] for i, j in near) == (bits > 0)
    for i, j in near.tolist():
        assert own[i] >= own[j] or (i, int(own[j])) in seen


@pytest.mark.parametrize("d", [1, 5, 16, 64, 100])
def test_budgets_and_rotation(d):
    blocks = S.block_budgets(d)
    assert [b[0] for b in blocks] == [0, *[b[1] for b in blocks[:-1]]] and blocks[-1][1] == d
    assert 0.14 <= sum(b[2] for b in blocks) < 0.14 + 1e-6
    assert np.allclose(S.rotation(d) @ S.rotation(d).T, np.eye(d))


@pytest.mark.parametrize("d", [2, 20, 64])
def test_against_all_pairs(spark, monkeypatch, d):
    """Small cells and tiles, so that visits, several homes and several parts of visitors all occur."""
    for k, v in (("CELL", 8), ("HOME", 16), ("VISITORS", 24)):
        monkeypatch.setattr(S, k, v)
    rows = planted(150, d, d)
    assert result(S.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_dense_group(spark, monkeypatch):
    """A third of all vectors are near copies of one, and many are the same vector."""
    for k, v in (("CELL", 16), ("HOME", 20), ("VISITORS", 30)):
        monkeypatch.setattr(S, k, v)
    r = np.random.default_rng(5)
    base = r.standard_normal(64)
    rows = planted(80, 64, 9, 2)
    rows += [(1000 + i, (base + r.standard_normal(64) * 0.15).astype(np.float32).tolist(), 1, "x", 7) for i in range(100)]
    rows += [(2000 + i, base.astype(np.float32).tolist(), 1, "x", 7) for i in range(60)]
    assert result(S.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    """Nulls anywhere, zeros, no components, other lengths, tiny and huge values, repeated rows, rows without an id, ties."""
    v = [3.0, 4.0, 0.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [3.0, None, 0.0], 1),
        (9, [math.nan, 1.0, 0.0], 1), (10, [math.inf, 1.0, 0.0], 1), (11, [3.0, 4.0], 1), (12, [3e-30, 4e-30, 0.0], 1), (13, [3e30, 4e30, 0.0], 1), (14, [-3.0, -4.0, -0.0], 1),
        (None, [0.0, 0.0, 5.0], 3), (None, [0.0, 0.1, 5.0], 3), (15, [3.0, 4.0, -0.0], 1), (None, None, None), (16, [0.93, math.sqrt(1 - 0.93**2), 0.0], 4), (17, [1.0, 0.0, 0.0], 4),
    ]
    rows = [(*r, "x", 7) for r in rows]
    assert result(S.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty(spark):
    assert S.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    """The registered query against all pairs of the driver's table."""
    got = {r.vec_id: r for r in S.op11_subspace_join(spark, sf).collect()}
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in got.values()), key=repr) == brute(rows)
