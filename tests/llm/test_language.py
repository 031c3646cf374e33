import zlib

import numpy as np
import pyarrow as pa

from hopsight.llm import language

SF = "/root/testdata/sf0.01"


def slow_profile(text):
    """The bundled vector by the definition, letter by letter."""
    out, letters = np.zeros(language.DIM), "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined = " " + " ".join(letters) + " "
    for i in range(len(joined) - 2 if letters else 0):
        bound = np.ones(language.DIM)
        for j, c in enumerate(joined[i:i + 3]):
            bound = bound * np.roll(language._letter(0 if c == " " else ord(c)), 2 - j)
        out += bound
    return out


def test_profiles_follow_the_definition(monkeypatch):
    samples = ["The cat sat, on it's mat!", "É ñandú  über 12 straße", "", None, "1 2 3 !", "a", "日本語のテキスト и кириллица", "ab " * 40]
    expected = np.stack([slow_profile(t) for t in samples])
    for bound, cells in ((1 << 13, 1 << 22), (3, 5)):
        monkeypatch.setattr(language, "BOUND", bound)
        monkeypatch.setattr(language, "CELLS", cells)
        assert (language.profiles(pa.array(samples)) == expected).all()


def test_held_out_accuracy(spark):
    found = language.query(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(langs)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in langs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog", "xx", ""), (2, "le chat et les chiens", "yy", ""), (None, "the cat", None, ""), (4, None, "xx", ""), (5, "42 !", "yy", "")]
    df = spark.createDataFrame(rows, schema)
    found = {r.doc_id: (r.lang_pred, r.score > 0) for r in language.identify(df, df).collect()}
    assert found == {1: ("xx", True), 2: ("yy", True), None: ("xx", True), 4: ("und", False), 5: ("und", False)}
    assert language.identify(df, df.filter("false")).select("lang_pred").distinct().collect() == [("und",)]
    assert language.identify(df.filter("false"), df).collect() == []


def test_a_rare_language_is_learned_beside_a_large_one(spark):
    """The sample has a rate of its own for each language."""
    rows = [(i, "the cat and the dog and the house", "xx") for i in range(400)] + [(1000 + i, "le chat et les chiens dans la maison", "yy") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(df, df, train_docs=5).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in found} == {"xx": 400, "yy": 3}
