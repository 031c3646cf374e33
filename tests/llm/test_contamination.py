import random

import pytest

from hopsight.llm import contamination

DOCS, ITEMS = "doc_id long, text string, _bad string, _row_key long, k string, r string", "item_id long, text string, doc_id int"


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS))


def brute(docs, items):
    """Every alignment and every stretch of it, place by place."""
    out = {}
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            b = item.lower().split()
            span = min(10, len(b))
            found = []
            for shift in range(span - len(b), len(w) - span + 1):
                eq = {k: w[k] == b[k - shift] for k in range(max(0, shift), min(len(w), shift + len(b)))}
                places = sorted(eq)
                for x in range(len(places)):
                    m = 0
                    for y in range(x, len(places)):
                        m += eq[places[y]]
                        n = y - x + 1
                        if n >= span and 100 * m >= 80 * n:
                            found.append((-m, n, places[x]))
            if found:
                m, n, start = min(found)
                out[d, i] = (start, n, -m)
    return out


def changed(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"other{rng.randrange(10 ** 9)}"
    return words


CASES = [(10, 1), (10, 2), (12, 2), (15, 3), (20, 4), (23, 4), (40, 8), (5, 0), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_no_overlap_of_80_percent_is_lost(spark, monkeypatch, broadcast):
    monkeypatch.setattr(contamination, "BROADCAST_SEEDS", broadcast)
    rng = random.Random(8)
    items, docs = [], []
    for length, n in CASES:
        for _ in range(40):
            item = [f"w{rng.randrange(10 ** 9)}" for _ in range(length)]
            items.append((len(items), " ".join(item)))
            docs.append((len(docs), " ".join(["before"] * rng.randrange(3) + changed(rng, item, n) + ["after"] * rng.randrange(3))))
    found = {r.doc_id: r for r in contamination.overlaps(*tables(spark, docs, items)).collect()}
    assert {(r.doc_id, r.item_id) for r in found.values()} == {(i, i) for i in range(len(items))}
    assert all(r.matched * 100 >= r.words * 80 for r in found.values())


def test_equals_brute_force_on_few_words(spark):
    """A vocabulary so small that alignments, stretches and ties abound."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("abc", k=rng.randint(5, 24)))) for i in range(12)]
    docs = [(100 + i, " ".join(rng.choices("abc", k=rng.randint(3, 60)))) for i in range(30)]
    docs += [(200 + i, " ".join(changed(rng, t.split() * 2, len(t.split()) // 3))) for i, t in items]
    found = {(r.doc_id, r.item_id): (r.start, r.words, r.matched) for r in contamination.overlaps(*tables(spark, docs, items)).collect()}
    assert found == brute(docs, items) and len(found) > 30


def test_an_exact_stretch_within_weak_ones_counts(spark):
    rng = random.Random(1)
    item = [f"w{i}" for i in range(60)]
    weak = list(item)
    for k in [*range(0, 20, 5), *range(21, 25), *range(35, 60, 2)]:
        weak[k] = f"no{k}"
    docs = [(1, " ".join(weak)), (2, " ".join(changed(rng, item, 30))), (3, "clean text of other words")]
    found = {r.doc_id: (r.start, r.words, r.matched) for r in contamination.overlaps(*tables(spark, docs, [(7, " ".join(item))])).collect()}
    expected = brute(docs, [(7, " ".join(item))])
    assert found == {d: v for (d, _), v in expected.items()} and 1 in found


def test_clean_keeps_columns_of_any_name(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs, items = tables(spark, [(1, item), (1, item), (2, "clean"), (None, None), (3, "")], [(1, item)])
    left = contamination.clean(docs, items)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(map(str, docs.filter("doc_id <> 1 OR doc_id IS NULL").collect()))
