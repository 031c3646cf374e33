import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopsight.llm import embeddings


def brute(rows, threshold):
    fit = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0) for _, v in rows]
    n, links, group = len(rows), [0] * len(rows), list(range(len(rows)))
    units = [embeddings.unit(np.array([v], np.float32))[0] if f else None for (_, v), f in zip(rows, fit)]
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return sorted((i, k, least[g], i == least[g]) for (i, _), k, g in zip(rows, links, group))


@pytest.mark.parametrize("per_cell,block", [(20, 16), (500, 1024)])
def test_equals_brute_force(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(embeddings, "PER_CELL", per_cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(per_cell)
    rows = []
    for size, noise in ((150, .02), (40, .25), (60, .4), (3, .0), (100, 2.0), (1, 0)):
        centre = rng.normal(size=8)
        for _ in range(size):
            v = (centre + noise * rng.normal(size=8)) * rng.choice([1, 10])
            rows.append((len(rows), v.astype(np.float32).tolist()))
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [1.0] * 7 + [float("nan")]),
             (1004, [1.0] * 7 + [float("inf")]), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, rows[5][1]), (1009, rows[5][1]), (1010, [3e38] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == brute(rows, 0.95)


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, vid string"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0], "a"), (7, [1.0, 0.0], None), (None, None, "b")], schema)
    assert sorted(map(str, map(tuple, embeddings.near_duplicates(df).collect()))) == [
        "(7, 1, 7, True)", "(None, 0, None, True)", "(None, 1, 7, False)"]


def test_near_uniform_vectors_are_stored_once(spark, monkeypatch):
    """Vectors are not copied into cells, also where a link could lie across most of them."""
    monkeypatch.setattr(embeddings, "PER_CELL", 100)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(6000, 64)).astype(np.float32)
    vectors[5000:] = vectors[:1000] + rng.normal(size=(1000, 64)) * rng.choice([.1, .25, .32], (1000, 1))
    stored = []

    def counted(df, cut=embeddings.cut):
        out = cut(df)
        stored.extend(out.agg(F.sum(F.length(c))).first()[0] or 0 for c, kind in out.dtypes if kind == "binary")
        return out
    monkeypatch.setattr(embeddings, "cut", counted)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(6000)), "embedding": pa.array(list(vectors))}))
    found = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    units = embeddings.unit(vectors)
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    assert 400 < links.sum() < 2000 and [found[i].n_links for i in range(6000)] == links.tolist()
    assert sum(stored) < 1.5 * vectors.nbytes


def test_large_cells_are_dealt_to_several_tasks(spark, monkeypatch):
    for name, value in (("PER_CELL", 200), ("HELD", 256), ("WAVE", 5), ("READ", 512), ("PACKED", 64)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(2, 8))
    rows = [(i, (centre[int(i % 9 == 0)] + rng.choice([.05, .3]) * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.unionOutputPartitioning", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == brute(rows, 0.95)
    assert settings == {k: spark.conf.get(k, None) for k in settings}
