import hashlib

import numpy as np

from hopsight.llm import codes

SCHEMA = "vec_id long, label int, embedding array<float>, code string, _label string"


def brute(rows):
    """Plain k-means in whole numbers over every entry, without bounds."""
    kept = sorted(((i, label, [int(np.floor(4096 * float(np.float32(x)))) for x in v]) for i, label, v in rows
                   if v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 8
    parts = [[r[2][p * w:(p + 1) * w] for r in kept] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for part, book in zip(parts, books):
            at = [nearest(x, book)[1] for x in part]
            for k in set(at):
                mine = [x for x, a in zip(part, at) if a == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[nearest(x, book) for x in part] for part, book in zip(parts, books)]
    out, by_label = [], {}
    for n, (i, label, _) in enumerate(kept):
        error = sum(f[n][0] for f in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{f[n][1]:02x}" for f in found), error))
    return sorted([(*r, by_label[r[1]], digest) for r in out], key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 16))
    rows = [(100 - i, [None, 1, 1, 2][i % 4], (centres[i % 5] + .2 * rng.normal(size=16)).tolist()) for i in range(90)]
    rows += [(50, 7, rows[3][2]), (50, 7, rows[3][2]), (None, 7, rows[4][2]), (200, 1, [0.0] * 16), (201, 1, [-30000.0] + [0.0] * 15)]
    bad = [(1, 1, None), (2, 1, [1.0] * 15 + [None]), (3, 1, [float("nan")] * 16), (4, 1, [float("-inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + bad], SCHEMA).repartition(5)
    found = codes.encode(df)
    assert found.columns == ["vec_id", "label", "code", "error", "codebooks_sha256", "label_error"]
    assert sorted([tuple(r[c] for c in ("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")) for r in found.collect()], key=str) == brute(rows)


def test_few_rows_empty_tables_and_mixed_dimensions(spark):
    assert codes.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 5, [1.0] * 8, "", ""), (2, None, [2.0] * 8, "", ""), (3, None, [1.0] * 3, "", ""), (4, 5, [], "", "")], SCHEMA)
    found = {r.vec_id: r for r in codes.encode(df).collect()}
    assert {i: r.code for i, r in found.items()} == {1: "00" * 8, 2: "01" * 8, 3: "00" * 8, 4: "00" * 8}
    assert all(r.error == r.label_error == 0 for r in found.values())
    assert found[1].codebooks_sha256 == hashlib.sha256(",".join(["4096,8192"] * 8).encode()).hexdigest() != found[3].codebooks_sha256


def test_bounds_prune_and_ties_go_to_the_lower_entry():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-150, 150, (3000, 8))
    entries = np.concatenate([centres, centres[:4]])
    pivots = codes.choose_pivots(entries)
    best, least, seen = codes.nearest(x, codes._distances(x, pivots).astype(np.float32), entries, codes._distances(entries, pivots))
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all() and best.max() < 16
    assert seen < 0.5 * d.size
