import random
import re

import numpy as np
import pytest

from hopsight.llm import minhash
from hopsight.llm.common import components


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(least.get(g, d), d)
    return sorted((d, len(s), least[g], d == least[g]) for (d, _), s, g in zip(rows, sets, group))


def corpus(seed, edits):
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (1, 2, 3, 40, 1, 1, 5, 60):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.choice((1, 2, 8, 60, 200)))]
        for _ in range(size):
            ws = list(base)
            for _ in range(rng.randint(0, edits) if len(ws) > 30 else 0):
                ws[rng.randrange(len(ws))] = rng.choice("xyz") + str(rng.randint(0, 999))
            rows.append((i, rng.choice((" ", "\n")).join(ws) if rng.random() < .9 else " ".join(ws).upper()))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent,few", [(3, 85, 32), (3, 85, 2), (5, 80, 32)])
def test_equals_brute_force(spark, monkeypatch, k, percent, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 7 if few == 2 else 256)
    monkeypatch.setattr(minhash, "ROUNDS", 1 if few == 2 else 4)
    rows = corpus(k + few, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = minhash.groups(df, k, percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == brute(rows, k, percent)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((5, 3), (40, 20), (300, 240), (2000, 1000)):
        hits = []
        for _ in range(30):
            e = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            both = np.concatenate([e[:n], e[n - shared:]])
            s = minhash.signatures(both, np.repeat([0, 1], n), 2, 120)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - shared / (2 * n - shared)) < 0.04
        assert (s < np.iinfo(np.uint64).max).all()


def test_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "a"), (1, text + " x", "b"), (1, text + " x", "b"), (2, "other words here", None), (None, text, "c"), (None, "alone", "c"), (4, None, "d")]
    left = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, row_key string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.dedup(empty).collect() == [] and minhash.groups(empty).collect() == []


def test_earlier_components_are_merged_not_computed_anew(spark):
    rng = random.Random(5)
    schema = "u long, v long"
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(i, i + 1) for i in range(100, 130)]
    for second in ([(rng.randrange(90), rng.randrange(90)) for _ in range(25)] + [(129, 7), (200, 201)], [(100, 130)], []):
        known = components(spark.createDataFrame(first, schema))
        whole = components(spark.createDataFrame(first + second, schema))
        merged = components(spark.createDataFrame(second, schema), known)
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_rounds_take_few_jobs(spark):
    """The driver keeps something of every job, and each round of leaders used to run all components again."""
    df = spark.createDataFrame(corpus(35, 6), "doc_id long, text string").repartition(3).localCheckpoint()
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        minhash.groups(df, 3, 85).collect()
    finally:
        spark.sparkContext.setJobGroup(None, None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 100
