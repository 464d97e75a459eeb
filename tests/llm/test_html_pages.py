"""Extraction from whole pages: wrappers, names, odd markup, generated pages with known text, and the table's pages by a plain parser."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from geolathe.llm import html

PARAGRAPH = "<p>Some words that a reader came for, told at length.</p>"
WANT = "Some words that a reader came for, told at length."


@pytest.mark.parametrize("page", [
    '<div class="layout with-sidebar"><article>{}</article></div>',
    '<div id="page" class="has-header"><main>{}</main></div>',
    '<div class="sidebar">\n<article>{}</article><div class="ad">Buy now</div></div>',
    '<form id="aspnetForm"><div class="menu"><a>Home</a></div><main>{}</main></form>',
    '<header><main>{}</main></header>',
    '<aside><article><p>A teaser of something else</p></article></aside><article>{}</article>',
    '<div class="comments"><article><p>One reader said so</p></article><article><p>Another did</p></article></div><article>{}</article>',
    '<article><div class="comment-list"><div class="content">Not so</div></div>{}</article>',
    '<article>{}<ul class="share-buttons"><li><a>Tell</a></ul><div class="google-ads">Buy</div><p class="ad">Buy</p></article><div class="cookie-banner">Cookies</div>',
    '<body class="sidebar-left"><nav><a>Home</a></nav><article>{}</article>',
])
def test_wrappers_mark_nothing_and_trimmings_go(page):
    assert html.main_text(page.format(PARAGRAPH)) == WANT


@pytest.mark.parametrize("inner", ['<p class="share-price">It rose.</p>', '<div class="tags-explained">It rose.</div>', '<section id="copyright"><p>It rose.</p></section>', '<h2 id="search">It rose.</h2>', '<div class="entry-header">It rose.</div>', '<div class="Cookie-Recipes">It rose.</div>', '<div class="discussion">It rose.</div>', '<div id="related">It rose.</div>'])
def test_names_that_mean_the_subject_stay(inner):
    assert html.main_text(f"<article>{PARAGRAPH}{inner}</article>") == WANT + "\nIt rose."


@pytest.mark.parametrize("names,kind", [("sidebar", html.NAMED), ("with-sidebar", html.NONE), ("siteFooter", html.WEAKLY_NAMED), ("comment-12", html.COMMENTS), ("post-content", html.CONTENT_NAME), ("ad", html.NAMED), ("ad-leaderboard", html.NAMED), ("header", html.WEAKLY_NAMED), ("read-only", html.NONE), ("--", html.NONE), ("related_posts", html.NAMED)])
def test_names(names, kind):
    assert html.kind_of(names) == kind


ODD = ["<a ", '<a "', "<a '\"", "<!", "<!--", "<script ", "<svg>", "<title>", "<div class=", "&amp", "<div>", "</p>", "<span class=ad>", "<form>", "<article>", "</div", "<![CDATA[", "<b x='>'>", "< "]


@pytest.mark.parametrize("odd", ODD)
def test_odd_markup_takes_time_in_proportion(odd):
    page = odd * (1_000_000 // len(odd))
    at = time.process_time()
    html.main_text(page)
    html.main_text("<div>" * 40_000 + page[:100_000] + "</p>" * 40_000)
    assert time.process_time() - at < 8


def test_random_tags_end():
    rng = random.Random(1)
    for _ in range(200):
        page = "".join(rng.choices([*ODD, "</article>", "</main>", "</form>", "</span>", "<p>", "word ", "</svg>", "<br>", "\x00", "é"], k=300))
        texts, facts = html.blocks(page)
        assert len(texts) == len(facts) and all(f[0] == len(t.split()) for t, f in zip(texts, facts))


def _page(rng: random.Random, marked: str) -> tuple[str, list[str], list[str]]:
    """A page, the blocks of its text, and those of its trimmings."""
    words = lambda a, b: " ".join(rng.choices(["north", "river", "of", "the", "stone", "walked", "and", "city", "over"], k=rng.randint(a, b)))
    good = [words(4, 9)] + [words(25, 90) for _ in range(rng.randint(3, 8))]
    menu, side, notes = [words(1, 2) for _ in range(5)], [words(3, 6) for _ in range(4)], [words(8, 60) for _ in range(rng.randint(0, 5))]
    foot = [words(3, 9)]
    body = f"<h1>{good[0]}</h1>" + "".join(f"<p>{g}</p>" for g in good[1:])
    links = lambda texts: "<ul>" + "".join(f"<li><a href=x>{t}</a></li>" for t in texts) + "</ul>"
    if marked == "none":
        return f"<div><div>{links(menu)}</div><div>{body}</div><div>{links(side)}</div><div>{foot[0]}</div></div>", good, menu + side + foot
    article = {"article": f"<article>{body}</article>", "name": f"<div class='post-content'>{body}</div>", "main": f"<main><section>{body}</section></main>"}[marked]
    replies = "<section class='comments'>" + "".join(f"<article class=comment><p>{n}</p></article>" for n in notes) + "</section>"
    page = f"<div class='nav-bar'>{links(menu)}</div>{article}<div id='sidebar'>{links(side)}</div>{replies}<div class='site-footer'>{foot[0]}</div>"
    return rng.choice(["{}", "<div class='page has-sidebar'>{}</div>", "<form>{}</form>" if marked != "name" else "{}", "<div class='container with-ads'><div class=row>{}</div></div>"]).format(page), good, menu + side + notes + foot


@pytest.mark.parametrize("marked,least", [("article", 1.0), ("main", 1.0), ("name", 0.99), ("none", 0.95)])
def test_generated_pages(marked, least):
    rng = random.Random(marked)
    right = total = 0
    for _ in range(150):
        page, good, rest = _page(rng, marked)
        got = html.main_text(page).split("\n")
        right += sum(g in got for g in good) + sum(r not in got or r in good for r in rest)
        total += len(good) + len(rest)
    assert right / total >= least


class Plain(HTMLParser):
    """Blocks of the article by the standard library's parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.now = [], [], []

    def _end(self) -> None:
        t = " ".join("".join(self.now).split())
        self.texts += [t] if t else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "article", "ul", "li", "table", "tr", "td", "section", "h2", "h3"):
            self._end()
        if tag == "br":
            self.now.append("\n")
        elif tag not in ("meta", "img", "hr", "input", "p", "link"):
            self.open.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article", "ul", "li", "table", "tr", "td", "section", "h2", "h3"):
            self._end()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        trimmed = {"nav", "aside", "footer", "form", "script", "style"} & set(tags) or any(set(c.split()) & {"ad", "comments", "comment", "sidebar", "cookie", "notice", "related", "share"} for _, c in self.open)
        if "article" in tags and not trimmed:
            self.now.append(data)


def test_the_pages_of_the_tables_by_a_plain_parser():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).column(0).to_pylist()
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain._end()
        assert html.main_text(page) == "\n".join(plain.texts)
