import random

from hopsight.llm import lines

DOCS = "doc_id long, text string, _flags string, _row_key string, flags int, r string"
NAMES = "amber blue coral dusk ember fern gold hazel iris jade kelp lilac".split()


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "a", "b", 3, "c") for i, t in rows], DOCS)
    out = lines.dedup(df)
    assert out.columns == [*df.columns, "_lines", "_dropped"]
    found = out.collect()
    assert len(found) == len(rows) and all((r._flags, r._row_key, r.flags, r.r) == ("a", "b", 3, "c") for r in found)
    return {r.doc_id: r for r in found}


def test_several_templates_of_one_leaf(spark):
    """Two families of one length and the same first three words, whose fields are words without digits."""
    rows = [(i, f"Shared with you by {n} from the old library\n{n} has own words") for i, n in enumerate(NAMES)]
    rows += [(20 + i, f"{n} is my own word\nShared with you because {n} liked a new song") for i, n in enumerate(NAMES)]
    found = run(spark, rows)
    for i in range(12):
        assert ("Shared" in found[i].text) == (i == 0) and found[i]._dropped == (i > 0)
        assert ("Shared" in found[20 + i].text) == (i == 0) and found[20 + i]._dropped == (i > 0)


def test_lines_of_numbers_recur_only_word_for_word(spark):
    rng = random.Random(2)
    rows = [(i, f"{rng.randrange(999)} {rng.randrange(999)} {rng.randrange(999)}\n{1900 + i}\nyear {i} of {i * 7} {i * 9}\n12 34 56") for i in range(12)]
    found = run(spark, rows)
    for i, text in rows:
        assert found[i].text == (text if i == 0 else "\n".join(text.split("\n")[:3]))


def test_prose_with_a_common_beginning_stays(spark):
    rng = random.Random(4)
    rows = [(i, "It was the " + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(9))) for i in range(40)]
    assert all(r._dropped == 0 for r in run(spark, rows).values())


def test_very_long_texts_and_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lines, "HOT_SHARE", 5)
    own = "\n".join(f"row {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} stays" for i in range(5000))
    rows = [(i, f"All rights reserved by nobody\n{own if i == 5 else 'x'}\nPage {i} of the collected works") for i in range(15)]
    rows += [(100, "All rights reserved by nobody\n" * 400 + "end")]
    found = run(spark, rows)
    assert found[0].text == rows[0][1] and found[5].text.count("stays") == 5000 and found[5]._dropped == 2
    assert found[3]._dropped == 3 and found[3].text == "" and found[100].text == "end"
