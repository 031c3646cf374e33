import itertools

import numpy as np
import pytest

from hopsight.llm import html, labelled_pages

# Hand-written pages; every text of the article starts with "Keep", every other one with "Drop".
PAGES = ["""<!DOCTYPE html><html><head><title>Drop title</title><style>p{}</style><script>var a="</p>Drop";</script></head><body>
<header class="site-header"><h1>Drop site</h1></header><nav><ul><li><a href="/">Drop home</a><li><a href="/b">Drop about</a></ul></nav>
<div class="cookie-notice">Drop this site uses cookies.</div>
<article><h1>Keep a &amp; b</h1><p>Keep   one&nbsp;two<br>three, with a long enough sentence to be read as prose.<p>Keep second
paragraph &copy 2020 &#233; unclosed <b>bold<div class="ad">Drop advert text, buy it now!</div><p>Keep after the advert, some more words here.</p></article>
<section class="comments"><h3>Drop comments</h3><p>Drop I liked this article very much, and would read more of it.</p></section>
<aside class="sidebar"><a href="/x">Drop related</a></aside><form><label>Drop e-mail</label><button>Drop send</button></form>
<footer>&copy; Drop &middot; footer</footer></body></html>""",
         """<body><div class="navbar"><a href="/">Drop home</a></div><div id="content"><h2>Keep heading of it</h2><p>Keep the first paragraph of this page.</p>
<ul><li>Keep item one of the list<li>Keep item two of the list</ul></div><div id="comments"><div class="comment">Drop what a nice text, thank you.</div></div>
<div class="footer">Drop 2020</div>"""]


def test_hand_written_pages():
    learned = html.model()
    for page in PAGES:
        found = html.blocks(page)
        assert [t for t, *_ in found if "Keep" in t] == learned.extract(page).split("\n\n")
    assert "Keep one two three, with" in learned.extract(PAGES[0]) and "Keep a & b" in learned.extract(PAGES[0])
    assert "Keep second paragraph © 2020 é unclosed bold\n\nKeep after" in learned.extract(PAGES[0])


def test_held_out_accuracy():
    learned, right, total = html.model(), 0, 0
    for page in labelled_pages.pages(100, seed=5):
        found = html.blocks(page, learned.weights)
        right += sum(x == b[3] for x, b in zip(learned.decode(found), found))
        total += len(found)
    assert right >= 0.98 * total


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        step = rng.normal(size=(2, 2, 2))
        weights = {str(i): tuple(rng.normal(size=2).tolist()) for i in range(6)}
        found = [("t", [str(i) for i in rng.integers(0, 6, 3)], int(rng.integers(0, 2)), False) for _ in range(6)]
        def score(path):
            s = sum(weights[f][y] for y, b in zip(path, found) for f in b[1])
            return s + sum(step[int(x[2] == z[2])][a][b] for a, b, x, z in zip(path, path[1:], found, found[1:]))
        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert html.Model(weights, step).decode(found) == [bool(y) for y in best]


@pytest.mark.parametrize("page", ["", "<p", "no tags at all", "<" * 2000, "</div></p>" * 50, "<div>" * 3000 + "deep", "<!-- open", "<script>x", "a&am"])
def test_broken_markup(page):
    html.model().extract(page)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (None, None, "", 6), (2, "u", PAGES[0], 7), (2, "u", PAGES[0], 7)],
                               "page_id long, url string, html string, n_chars int")
    found = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars == len(r.text), r.n_chars > 0) for r in found) == [
        (0, True, False), (1, True, False), (2, True, True), (2, True, True)]
    assert html.extract(df.filter("false")).collect() == []
