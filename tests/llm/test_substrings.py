import hashlib
import random
import re

import pytest

from hopsight.llm import substrings


def brute(rows, window):
    """rows: (doc_id, text); by the definition, on lists of words."""
    docs = [(2**63 - 1 if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = {}
    for d, ws in docs:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i:i + window])
            seen[k] = min(seen.get(k, (d, i)), (d, i))
    out = []
    for (doc_id, _), (d, ws) in zip(rows, docs):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i:i + window])] < (d, i):
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, window, piece):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest())
            for r in substrings.dedup(df, window, piece).collect()]


@pytest.mark.parametrize("piece", [300, 8 << 20])
def test_equals_brute_force(spark, piece):
    rng = random.Random(5)
    passage = [[f"p{i}_{rng.randint(0, 9)}" for _ in range(rng.randint(15, 60))] for i in range(8)]
    rows = []
    for d in rng.sample(range(1000), 120):
        ws = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p, at = rng.choice(passage), rng.randint(0, len(ws))
            a = rng.randint(0, 5)
            ws[at:at] = p[a:len(p) - rng.randint(0, 5)]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(2000 + i, rows[3][1]) for i in range(5)]  # exact copies
    rows += [rows[0], rows[7], rows[7], (None, rows[5][1]), (None, None), (3000, None), (3001, ""), (3002, "é " * 200), (3003, "x " * 25 + "Ly " * 90)]
    rows.append((3004, " ".join(f"w{i % 700}" for i in range(3000))))
    assert sorted(result(spark, rows, 20, piece), key=str) == brute(rows, 20)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(empty).collect() == []
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, row_key string, marks int")
    assert substrings.dedup(df).select("doc_id", "text").collect() == [(1, "a b")]
