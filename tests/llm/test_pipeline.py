"""Each stage of the pipeline against brute force or SQL on its own input, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from checks import compare
from hopsight.llm import contamination, language, lines, mixing
from hopsight.llm.common import cut
from tests.llm.test_minhash import brute as brute_groups

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return {r.doc_id for r in df.collect()}


def sql(docs, text):
    con = compare.connect(SF)
    con.execute("DROP VIEW documents")
    con.register("documents", docs.toArrow())
    return con.execute(text).fetchall(), [d[0] for d in con.description]


def slow_profile(text):
    out, words = np.zeros(language.DIM), "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined = " " + " ".join(words) + " "
    for gram, n in Counter(joined[i:i + 3] for i in range(len(joined) - 2 if words else 0)).items():
        bound = np.ones(language.DIM)
        for j, c in enumerate(gram):
            bound = bound * np.roll(language._letter(0 if c == " " else ord(c)), 2 - j)
        out += n * bound
    return out


def test_stages_in_order():
    assert list(STAGE) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert stages[-1].columns == [*stages[0].columns, "copies"]


def test_language_stage(stages):
    rows, sums, letters = stages[0].collect(), {}, {}
    unit = {r.doc_id: v / (np.linalg.norm(v) or 1) for r in rows for v in [slow_profile(r.text)]}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] = sums.get(r.lang, 0) + np.rint(unit[r.doc_id] * language.SCALE)
            letters.setdefault(r.lang, Counter()).update(c for c in r.text.lower() if c.isalpha())
    learned = {lang: p / np.linalg.norm(p) for lang, p in sums.items()}
    usual = {lang: sorted(c for c, n in found.items() if n >= language.LETTER_SHARE * sum(found.values())) for lang, found in letters.items()}
    needed = {lang: language.chance(p, usual[lang]) for lang, p in learned.items()}
    expected = set()
    for r in rows:
        score, lang = max((unit[r.doc_id] @ p, lang) for lang, p in learned.items())
        if score > (needed[lang] if sum(c.isalpha() for c in r.text or "") >= language.SHORT_LETTERS else language.MIN_SCORE):
            expected.add(r.doc_id)
    assert ids(stages[1]) == expected and len(expected) >= 0.95 * len(rows)
    assert {r.doc_id for r in rows if not re.search(r"[^\W\d_]", r.text or "")}.isdisjoint(ids(stages[1]))


def test_language_stage_rejects_noise_and_foreign_scripts(spark, stages):
    rng = np.random.default_rng(6)
    made = [" ".join("".join(rng.choice(list(letters), n)) for n in rng.integers(2, 10, 200)) for letters in
            ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω") for _ in range(100)]
    more = spark.createDataFrame([(10_000_000 + i, t, None, "web", len(t)) for i, t in enumerate(made)], stages[0].schema)
    left = ids(STAGE["language_id"](spark, stages[0].unionByName(more), SF))
    assert not any(d >= 10_000_000 for d in left)
    clean = {r.doc_id for r in stages[0].collect() if len(r.text or "") > 60 and re.search(r"[a-z]{2}", r.text) and len(set(r.text.split())) > 10}
    assert clean <= left


def test_line_stage(stages):
    found, names = sql(stages[1], lines.SQL)
    expected = {r[names.index("doc_id")]: r[names.index("kept_sha256")] for r in found}
    before = {r.doc_id: r for r in stages[1].collect()}
    after = {r.doc_id: r for r in stages[2].collect()}
    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in after.items()} == {d: h for d, h in expected.items() if d in after}
    for d, r in before.items():
        if d not in after:  # nothing but dropped lines
            assert expected[d] != hashlib.sha256(r.text.encode()).hexdigest()
        elif r.text == after[d].text:
            assert after[d].n_chars == r.n_chars
        else:
            assert after[d].n_chars == len(after[d].text)


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == {d for d, _, _, kept in brute_groups(rows, 5, 80) if kept}


def test_decontamination_stage(stages):
    found, names = sql(stages[3], contamination.SQL)
    assert ids(stages[4]) == ids(stages[3]) - {r[names.index("doc_id")] for r in found}


def test_mixing_stage(stages):
    found, names = sql(stages[4], mixing.SQL)
    size, taken = names.index("size"), names.index("taken")
    expected = {r[names.index("doc_id")]: r[taken] // r[size] for r in found if r[taken]}
    assert {r.doc_id: r.copies for r in stages[5].collect() if re.search(r"\S", r.text)} == expected


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_rows(spark, stages):
    """Nulls in every column, empty and repeated rows pass every stage without a failure."""
    some = [tuple(r) for r in stages[0].limit(20).collect()]
    rows = [*some, some[0], some[0], (None,) * 5, (900_001, None, "en", "web", None), (900_002, "", None, None, 0), (900_003, "word " * 40_000, None, None, None)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            found = stage(spark, given, SF)
            assert found.columns[:5] == docs.columns, name
            assert found.count() <= given.count(), name
