import numpy as np
import pyarrow as pa
import pytest

from hopsight.llm import minhash, substrings, words

#: A Thue-Morse word and its complement have equal hashes in any polynomial modulo a power of two.
A = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
B = A.translate(str.maketrans("ab", "ba"))


def hashes(texts, **kw):
    return words.hashed(*words.texts(pa.array(texts)), **kw)


def test_regular_words_have_hashes_of_their_own():
    given = [x[:n] for x in (A, B) for n in (512, 1024, 2048)] + [A + B, B + A, "a" * 3000, "a" * 3001, "b" * 3000]
    h, at = hashes(given)
    assert len(set(h.tolist())) == len(given) and np.diff(at).tolist() == [1] * len(given)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_hashes_depend_on_the_word_alone(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    texts = ["one two  one\ttwo", "ONE", "", None, "two\none ", "x" * 50 + " one"]
    h, at = hashes(texts, lower=True)
    assert np.diff(at).tolist() == [4, 1, 0, 0, 2, 2]
    assert h[0] == h[2] == h[4] == h[6] == h[8] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3


def test_regular_words_link_and_remove_nothing(spark):
    rest = [f"w{i}" for i in range(19)]
    df = spark.createDataFrame([(1, " ".join([A[:1024]] * 30)), (2, " ".join([B[:1024]] * 30)), (3, " ".join([A[:1024], *rest])), (4, " ".join([B[:1024], *rest]))],
                               "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.groups(df.filter("doc_id < 3")).collect()} == {1: 1, 2: 2}
    assert [r.n_removed for r in substrings.dedup(df.filter("doc_id > 2")).collect()] == [0, 0]
