"""Nulls, empty texts, ties, repeated rows, empty tables and clashing names, with hand-written results."""

import pytest

from hopsight.llm import chat, contamination, lines, mixing, substrings, urls

DOCS = "doc_id long, text string, source string, row_key string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, "clash", None) for d, t, s in rows], DOCS)


def test_empty_tables(spark):
    none, items = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    for found in (mixing.mix(none), mixing.mixed(none), lines.dedup(none), contamination.overlaps(none, items), contamination.clean(none, items),
                  substrings.dedup(none), chat.rotate(turns), urls.judge(pages, rules)):
        assert found.collect() == []


def test_targets_share_the_excess():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 10)], (1, 2, 3), 3) == {"a": 60.0, "b": 120.0, "c": 30.0}
    assert mixing.targets([(None, 60), ("a", 60)], (1, 2, 3), 3) == {"a": 40.0, None: 80.0}


def test_mixing_nulls_repeats_and_empty_sources(spark):
    rows = [(i, "w " * (1 + i % 5), "a") for i in range(60)] + [(None, "x y z", None)] * 2 + [(70, None, "b"), (71, "", "b"), (None, None, None)]
    found = mixing.mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    taken = {s: sum(r.taken for r in found if r.source == s) for s in ("a", "b", None)}
    assert {(r.source, r.source_size, r.target) for r in found} == {("a", 180, 168.0), ("b", 0, 0.0), (None, 6, 18.0)}
    assert taken["b"] == 0 and taken[None] == 18 and abs(taken["a"] - 168) <= 5
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    copies = [r.copies for r in mixing.mixed(docs(spark, rows).withColumnRenamed("h", "copies")).collect() if r.doc_id is None and r.text]
    assert copies == [3, 3]
    assert mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()[0].taken == 0


def test_mixes_are_nested(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(300)]
    small = {r.doc_id for r in mixing.mix(docs(spark, rows), (1, 5)).filter("source = 'a' AND copies = 1").collect()}
    large = {r.doc_id for r in mixing.mix(docs(spark, rows), (2, 5)).filter("source = 'a' AND copies = 1").collect()}
    assert small < large


@pytest.mark.parametrize("max_bits", [urls.MAX_BITS, 640])
def test_cascade_is_exact(spark, max_bits):
    universe = spark.range(3000).selectExpr("concat('k', id) AS key").unionAll(spark.sql("SELECT CAST(NULL AS STRING) AS key"))
    listed = universe.filter("key IS NULL OR crc32(key) % 7 = 0")
    cascade = urls.Cascade.build(listed.unionAll(listed), universe, max_bits)
    found = {r.key for r in universe.filter("key IS NOT NULL").filter(cascade.contains(universe.key)).collect()}
    assert found == {r.key for r in listed.filter("key IS NOT NULL").collect()}


def test_url_rules(spark):
    given = {1: "http://A.Example.COM/en/x?q", 2: "https://www.example.com/en/", 3: "http://x.org/es/", 4: None, 5: "no scheme", 6: "x://net/es/a",
             7: "x://net/en", 8: "x://aexample.com/en/", 9: "x://", 10: "http://de.net/fr/#a", 11: "http://com", 12: ""}
    pages = spark.createDataFrame([(k, u, "clash") for k, u in given.items()] + [(1, given[1], "clash")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    found = sorted(map(tuple, urls.judge(pages, rules).collect()))
    one = (1, "a.example.com", "/en/x", "example.com/en/", "block")
    assert sorted(found, key=str) == sorted([
        one, one, (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "x.org", "/es/", None, "allow"), (4, "", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "net", "/es/a", "net/es/", "block"), (7, "net", "/en", None, "allow"),
        (8, "aexample.com", "/en/", "com/", "allow"), (9, "", "", None, "allow"), (10, "de.net", "/fr/", "net/fr/", "block"),
        (11, "com", "", None, "allow"), (12, "", "", None, "allow")], key=str)


def test_templates_with_fields_recur(spark):
    rows = [(i, f"own text number{'abcdefghijklm'[i]} here\n\nShared by user {i} on day {i * 3} at noon\nend {'xyzuvwabcdefg'[i]}", "s") for i in range(12)]
    rows += [rows[3], (None, None, None), (50, "", None), (51, "\n", "s")]
    found = {(r.doc_id, r.text): (r.text, r._lines, r._dropped, r.row_key) for r in lines.dedup(docs(spark, rows)).collect()}
    left = lines.dedup(docs(spark, rows)).collect()
    assert len(left) == len(rows)
    for r in left:
        if r.doc_id is not None and r.doc_id < 12:
            assert ("Shared by" in r.text) == (r.doc_id == 0) and r._dropped == (r.doc_id > 0) and r._lines == 4
            assert r.text.startswith("own text") and "\n\n" in r.text
        else:
            assert r._dropped == 0 and r._lines == {None: 0, 50: 1, 51: 2}[r.doc_id]
    assert all(v[3] == "clash" for v in found.values())
    nine = [(i, "the very same line", "s") for i in range(9)] * 2
    assert all(r._dropped == 0 for r in lines.dedup(docs(spark, nine)).collect())


def test_contamination_tolerates_substitutions(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    changed = item.replace("seven ", "7 ")
    long = "pad " * 30_000
    items = spark.createDataFrame([(9, item, 1), (4, item.upper(), 1), (5, "short item of five words", 1), (6, "too short", 1), (7, None, 1), (8, "", 1)],
                                  "item_id long, text string, doc_id int")
    rows = [(1, f"intro {changed} outro", "s"), (2, "clean text of other words " * 5, "s"), (3, None, None), (4, "", "s"), (5, "too short", "s"),
            (6, f"{long}A short, item: of FIVE words!", "s"), (7, item, "s"), (7, item, "s"), (None, item, "s")]
    found = sorted(map(tuple, contamination.overlaps(docs(spark, rows), items).drop("row_key").collect()), key=str)
    assert [(d, i) for d, i, *_ in found] == [(1, 4), (6, 5), (7, 4), (None, 4)]
    by = {f[0]: f for f in found}
    assert by[7] == (7, 4, 0, 16, 16) and by[6] == (6, 5, 30_001, 5, 5)
    assert by[1][3] >= 10 and by[1][4] >= 0.8 * by[1][3]
    left = contamination.clean(docs(spark, rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5] and left.columns == docs(spark, []).columns


def test_chat_perspectives(spark):
    rows = [(1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 0, "system", "be kind"), (2, 1, None, "alone"), (3, 1, "system", "x"),
            (None, 1, "ann", "lost"), (None, 1, "ann", "lost")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    found = {(r.conv_id, r.perspective): r for r in chat.rotate(turns).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    r = found[1, "ann"]
    assert r.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n"
    masked = [r.text[int(a):int(b)] for a, b in (s.split(":") for s in r.spans.split(";"))]
    assert masked == ["hi < |end|><|end|>"] and r.n_masked == len(masked[0]) and r.n_messages == 3
    assert found[None, "ann"].n_messages == 2 and found[1, "bob"].spans
    parts = chat.rotate(turns, part=2).filter("conv_id = 1 AND perspective = 'ann'").orderBy("part").collect()
    assert "".join(p.text for p in parts) == r.text and [p.part for p in parts] == [0, 1]
