import numpy as np
import pytest

from hopsight.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("dim,size", [(40, 300), (6, 50), (40, 12)])
def test_equals_dense_eigendecomposition(spark, dim, size):
    rng = np.random.default_rng(dim + size)
    given = rng.normal(size=(size, dim)) * np.linspace(.2, 1.5, dim) + rng.normal(size=dim)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(given)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1))]
    found = whitening.whiten(table(spark, rows + bad).repartition(40)).collect()
    x = np.floor(64 * np.array([np.array(v, np.float32) for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (x - 1_000_000) - (s - n * 1_000_000) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(32, dim, np.linalg.matrix_rank(centred))
    assert {r.component for r in found} == set(range(1, rank + 1)) and len(found) == rank * n
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s)) for k, (i, _) in enumerate(rows)}
    at = {i: k for k, (i, _) in enumerate(rows)}
    sign = {}
    for r in found:
        c, k = r.component - 1, at[r.vec_id]
        assert r.n == n and int(r.deviation) == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - values[c] / values.sum()) < 1e-10 * r.explained
        expected = centred[k] @ vectors[:, c] / np.sqrt(values[c])
        sign.setdefault(c, np.sign(expected) * np.sign(r.whitened) if abs(expected) > 1e-3 else None)
        if sign[c]:
            assert abs(r.whitened - sign[c] * expected) < 1e-7
        else:
            del sign[c]


def test_no_variance_empty_tables_and_mixed_dimensions(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])])).collect() == []
    found = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), round(r.whitened, 9), round(r.explained, 9)) for r in found) == [
        (1, 1, 2, 128 ** 2, -1.0, 1.0), (2, 1, 2, 128 ** 2, 1.0, 1.0), (3, 1, 2, 64 ** 2, -1.0, 1.0), (4, 1, 2, 64 ** 2, 1.0, 1.0)]


def test_deviation_beyond_a_long_stays_exact(spark):
    rows = [(i, [30000.0 * (-1) ** i, float(i)]) for i in range(3000)]
    found = {r.vec_id: int(r.deviation) for r in whitening.whiten(table(spark, rows)).filter("component = 1").collect()}
    x = [[64 * int(a) + 1_000_000, 64 * int(b) + 1_000_000] for _, (a, b) in rows]
    s = [sum(c) for c in zip(*x)]
    assert found == {i: sum((3000 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(3000)} and max(found.values()) > 2 ** 63


@pytest.mark.parametrize("kind", ["normal", "repeated", "axes", "growing", "equal"])
def test_rank_one_updates_keep_the_decomposition(kind):
    rng = np.random.default_rng(3)
    d = 12
    data = {"normal": rng.normal(size=(60, d)), "repeated": np.repeat(rng.normal(size=(4, d)), 15, axis=0), "axes": np.eye(d)[rng.integers(0, d, 60)],
            "growing": rng.normal(size=(60, d)) * 10.0 ** rng.integers(-6, 6, (60, 1)), "equal": np.ones((60, d))}[kind]
    whole, left, right = (whitening.Spectrum(d) for _ in range(3))
    for i, x in enumerate(data):
        whole.add(x)
        (left if i < 25 else right).add(x)
    left.combine(right)
    scatter = (data - data.mean(axis=0)).T @ (data - data.mean(axis=0))
    for s in (whole, left, whitening.Spectrum.unpack(whole.pack(), d)):
        top = max(np.abs(scatter).max(), 1e-12)
        assert s.n == 60 and np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-11 * top + 1e-12
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12


def test_query_whitens(spark):
    found = whitening.query(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = found.groupBy("component").agg({"whitened": "var_pop", "identity_error": "max"}).collect()
    assert len(rows) == 32 and all(abs(r[1] - 1) < 1e-9 or abs(r[2] - 1) < 1e-9 for r in rows)
