"""HTML extraction by a linear-chain conditional random field over the leaf blocks of a page.

A block is the text between block-level tags. Its features are the tags, classes and ids of its
ancestors and shapes of its text; states are article and other; transitions depend on whether two
blocks share their container. Weights are fitted on labelled pages by stochastic gradients of the
likelihood (forward-backward); pages are decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import labelled_pages
from .common import read

EPOCHS, RATE, DECAY = 12, 0.3, 1e-4

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup "
              "time tt u var wbr label input button nobr".split())
_DROPPED = set("script style noscript template svg math iframe object canvas audio video".split())
#: A start tag of the key ends an open element of the values, up to the nearest enclosing element of the barrier.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = set("ul ol dl table select body html div section article main aside nav header footer form".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CUE = re.compile(r"©|copyright|all rights|cookie|privacy|subscribe|newsletter|sign up|log ?in|advert|sponsor|share|repl(?:y|ies)|comments?\b")


class Blocks(HTMLParser):
    """The blocks of one page: text, features, container, and whether it is labelled as article."""

    def __init__(self, known: dict | None):
        super().__init__(convert_charrefs=True)
        self.known, self.active = known, Counter()
        self.stack: list[tuple[str, list[str], int, bool]] = []
        self.found: list[tuple[str, list, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.dropped = self.links = self.opened = self.labelled = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            container = next((n for tag, _, n, _ in reversed(self.stack) if tag not in _INLINE and tag != "p" and tag[0] != "h"), 0)
            self.found.append((text, [*self.active, *self._shape(text)], container, self.labelled > 0))
        self.parts, self.linked = [], 0

    def _shape(self, text: str) -> list[str]:
        n, low, last = text.count(" ") + 1, text[:4000].lower(), self.stack[-1][0] if self.stack else ""
        share = self.linked / len(text)
        tag = next((t for t, *_ in reversed(self.stack) if t not in _INLINE), "")
        out = [f"own:{tag}", f"last:{last}", f"words:{sum(n >= k for k in (2, 4, 8, 15, 30))}", f"link:{sum(share > k for k in (0, .3, .8))}",
               f"stops:{min(3, sum(text.count(c) for c in '.!?'))}", f"ends:{text[-1] in '.!?'}"]
        if n < 40:
            out += [f"cue:{m}" for m in set(_CUE.findall(low))]
        out = out if self.known is None else [f for f in out if f in self.known]
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _INLINE:
            self._flush()
            self._imply(tag)
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        self.opened += 1
        features, label = [f"in:{tag}"], False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                features += [f"name:{t}" for t in _SPLIT.split(value.lower()[:500]) if t and not t.isdigit()]
            label = label or name == "data-y"
        features = [f for f in features if self.known is None or f in self.known]
        self.active.update(features)
        self.stack.append((tag, features, self.opened, label))
        self.labelled += label
        self.dropped += tag in _DROPPED
        self.links += tag == "a"

    def _imply(self, tag: str) -> None:
        closes = _ENDS.get(tag, set()) | {"p"}
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in closes:
                self._close(i)
            elif self.stack[i][0] in _BARRIER:
                break

    def _close(self, i: int) -> None:
        for tag, features, _, label in self.stack[i:]:
            self.active.subtract(features)
            for f in features:
                if not self.active[f]:
                    del self.active[f]
            self.labelled -= label
            self.dropped -= tag in _DROPPED
            self.links -= tag == "a"
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                break
            if tag in _INLINE and self.stack[i][0] not in _INLINE:
                break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str, known: dict | None = None) -> list[tuple[str, list, int, bool]]:
    parser = Blocks(known)
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.found


class Model:
    """weights: feature -> (other, article); step[same container][before][now]."""

    def __init__(self, weights: dict[str, tuple[float, float]], step: np.ndarray):
        self.weights, self.step = weights, step.tolist()

    def decode(self, found: list[tuple[str, list, int, bool]]) -> list[bool]:
        """Viterbi; of equal paths the one with more of 'other' from the end."""
        back, a, b, container = [], 0.0, 0.0, None
        for _, features, now, _ in found:
            w = [self.weights[f] for f in features if f in self.weights]
            ea, eb = sum(x[0] for x in w), sum(x[1] for x in w)
            if container is None:
                a, b = ea, eb
            else:
                s = self.step[now == container]
                pa_, pb = (a + s[0][0], b + s[1][0]), (a + s[0][1], b + s[1][1])
                back.append((pa_[1] > pa_[0], pb[1] > pb[0]))
                a, b = max(pa_) + ea, max(pb) + eb
            container = now
        out, state = [], b > a
        for choice in reversed(back):
            out.append(state)
            state = choice[state]
        return [*([state] if found else []), *reversed(out)]

    def extract(self, html: str | None) -> str:
        found = blocks(html or "", self.weights)
        return "\n\n".join(text for (text, *_), keep in zip(found, self.decode(found), strict=True) if keep)


def fit(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Gradients of the pages' likelihood, page by page, scaled by their running squares (AdaGrad)."""
    index: dict[str, int] = {}
    data = []
    for html in pages:
        found = blocks(html)
        if found:
            data.append(([np.array([index.setdefault(f, len(index)) for f in set(b[1])]) for b in found],
                         np.array([False] + [x[2] == y[2] for x, y in zip(found, found[1:])]).astype(int), np.array([int(b[3]) for b in found])))
    weights, step = np.zeros((len(index), 2)), np.zeros((2, 2, 2))
    seen_w, seen_s = np.full_like(weights, 1e-6), np.full_like(step, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for d in rng.permutation(len(data)):
            features, same, y = data[d]
            n = len(y)
            score = np.stack([weights[f].sum(axis=0) for f in features])
            ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
            ahead[0] = score[0]
            for i in range(1, n):
                ahead[i] = score[i] + np.logaddexp(*(ahead[i - 1][:, None] + step[same[i]]))
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp(*(step[same[i + 1]] + score[i + 1] + behind[i + 1]).T)
            total = np.logaddexp(*ahead[-1])
            wrong = -np.exp(ahead + behind - total)
            wrong[np.arange(n), y] += 1
            grad_w, grad_s = np.zeros_like(weights), np.zeros_like(step)
            np.add.at(grad_w, np.concatenate(features), np.repeat(wrong, [len(f) for f in features], axis=0))
            for i in range(1, n):
                grad_s[same[i]] -= np.exp(ahead[i - 1][:, None] + step[same[i]] + (score[i] + behind[i])[None, :] - total)
                grad_s[same[i], y[i - 1], y[i]] += 1
            for x, grad, seen in ((weights, grad_w, seen_w), (step, grad_s, seen_s)):
                seen += grad ** 2
                x += RATE * grad / np.sqrt(seen) - DECAY * x
    return Model({f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in index.items()}, step)


@cache
def model() -> Model:
    return fit(labelled_pages.pages())


def _extract(learned: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [learned.extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, learned: Model | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    The text's blocks are in page order, joined by an empty line, white space within a block is one
    space, character references are decoded. A null or empty page, and one without an article, has an
    empty text. Broken markup is read as browsers do, a tag cut off at the end is no text. Repeated rows
    and null ids are extracted like any; an empty table gives no rows; other columns are not looked at.
    """
    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(_extract(learned or model()), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
