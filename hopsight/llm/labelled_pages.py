"""Labelled pages that the page extractor learns from, composed from a small grammar of regions.

A page is a list of (text block, is article) under containers as sites write them. The number of
pages is the bound of the training set.
"""

from __future__ import annotations

import random

PAGES = 400

# Containers of the article, and of what is not part of it, as "tag", "tag.class" or "tag#id".
ARTICLE = ["article", "main", "main article", "div#content", "div.content article", "div.post-body", "div.entry-content", "section.story",
           "div#main div.text", "div.article-body", "article.post", "div.page div.body", "td.content", "", "div", "div div", "section"]
ASIDE = {
    "menu": ["nav", "nav ul", "div.menu", "div#nav ul", "ul.navbar", "header nav", "div.navigation", "ol.breadcrumb", "div.breadcrumbs", "ul#menu"],
    "header": ["header", "div.header", "div#header", "div.site-header", "div.masthead", "div.topbar", "header.top"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "footer div.legal", "div.site-footer"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.right-column div.widget", "section.related", "div.related-posts", "aside.related"],
    "notice": ["div.cookie-notice", "div#cookie-banner", "div.notice", "div.alert", "div.gdpr", "div.popup", "div.modal", "section.notice", "div.consent", "div.disclaimer", "div.warning"],
    "advert": ["div.ad", "div.ads", "div.advert", "div#ad-1", "aside.ad", "div.sponsored", "div.promo", "section.advertisement", "div.banner", "ins.adsbygoogle div"],
    "form": ["form", "form.newsletter", "div.subscribe form", "form#login", "form.search", "div.signup", "div.newsletter"],
    "comments": ["div.comments", "section.comments", "section#comments", "div#comments div.comment", "ul.commentlist li", "ol.comment-list li",
                 "div.comment", "div#disqus_thread", "div.reader-comments", "div.replies div.reply", "div.discussion", "article.comment"],
    "share": ["div.share", "div.social", "ul.tags", "div.pagination", "div.author-bio", "div.byline"],
}
_CUES = {"footer": ["© 2020 site", "Copyright 2019. All rights reserved", "Privacy | Terms"], "notice": ["This site uses cookies.", "Please accept our privacy policy"],
         "form": ["E-mail", "Subscribe", "Your name", "Sign up now", "Search", "Log in"], "share": ["Share this", "Tags:", "Next page", "1 2 3"],
         "advert": ["Advertisement", "Buy now, 50% off!", "Sponsored"], "comments": ["Reply", "Comments (3)", "Anna wrote on 3 May:"], "header": ["Daily News", "Home"]}


def _wrap(container: str, inside: str) -> str:
    for part in reversed(container.split()):
        tag, _, name = part.partition("#") if "#" in part else part.partition(".")
        mark = f' {"id" if "#" in part else "class"}="{name}"' if name else ""
        inside = f"<{tag}{mark}>{inside}</{tag}>"
    return inside


def _words(rng: random.Random, low: int, high: int) -> str:
    ws = ["".join(rng.choice("aeioubdfklmnrst") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(low, high))]
    text = " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in ws).capitalize()
    return text + rng.choice([".", ".", ".", "", "!"])


def _prose(rng: random.Random, low: int, high: int) -> str:
    """Words of an article; some mention what other blocks are known by."""
    text = _words(rng, low, high)
    return f"{text} {rng.choice(rng.choice(list(_CUES.values())))} {_words(rng, 1, 12)}" if rng.random() < .15 else text


def _article_block(rng: random.Random, y: str) -> str:
    kind = rng.random()
    if kind < .7:
        return f"<p {y}>{_prose(rng, 1, 90)}</p>"
    if kind < .8:
        return f"<h2 {y}>{_prose(rng, 1, 8)}</h2>"
    if kind < .88:
        return "<ul>" + "".join(f"<li {y}>{_prose(rng, 1, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
    tag = rng.choice(["blockquote", "pre", "div", "figcaption", "td"])
    return f"<{tag} {y}>{_prose(rng, 2, 60)}</{tag}>"


def _other(rng: random.Random, kind: str) -> str:
    if kind == "menu":
        items = "".join(f'<li><a href="/x">{_words(rng, 1, 2)}</a></li>' for _ in range(rng.randint(2, 8)))
        return _wrap(rng.choice(ASIDE[kind]), items)
    blocks = []
    for _ in range(rng.randint(1, 4 if kind in ("comments", "sidebar") else 2)):
        text = rng.choice(_CUES[kind]) if kind in _CUES and rng.random() < .4 else _words(rng, 1, 60 if kind in ("comments", "advert", "notice") else 25)
        if kind in ("sidebar", "share") and rng.random() < .6:
            text = f'<a href="/y">{text}</a>'
        tag = rng.choice(["p", "p", "div", "li", "h3", "span", ""] + (["label", "button"] if kind == "form" else []))
        blocks.append(f"<{tag}>{text}</{tag}>" if tag else text)
    return _wrap(rng.choice(ASIDE[kind]), rng.choice(["", " ", "<br>"]).join(blocks))


def pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """HTML whose article blocks carry the attribute data-y."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        y = "data-y"
        body = [f"<h1 {y}>{_words(rng, 2, 10)}</h1>"] if rng.random() < .8 else []
        for _ in range(rng.randint(1, 9)):
            body.append(_article_block(rng, y))
            if rng.random() < .12:
                body.append(_other(rng, rng.choice(["advert", "sidebar", "share", "form", "notice"])))
        if rng.random() < .2:
            body.append(_other(rng, rng.choice(["comments", "share"])))
        before = [_other(rng, k) for k in ("notice", "header", "menu", "advert", "sidebar", "form") if rng.random() < .45]
        after = [_other(rng, k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if rng.random() < .45]
        rng.shuffle(before)
        out.append(f"<html><head><title>{_words(rng, 2, 9)}</title></head><body>" + "".join(before)
                   + _wrap(rng.choice(ARTICLE), "".join(body)) + "".join(after) + "</body></html>")
    return out
