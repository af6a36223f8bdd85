"""Main text of pages: against a plain reading of real pages, against pages built round a known text, and hard pages."""

import os
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tidelog.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Plain(HTMLParser):
    """Blocks of the article, for pages whose article holds nothing but its text."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "a", "em"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "i", "a", "em"):
            self.blocks.append("")

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""

    @staticmethod
    def text(page):
        p = Plain()
        p.feed(page or "")
        p.close()
        return " ".join(b for b in (" ".join(b.split()) for b in p.blocks) if b)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no pages here")
def test_extract_of_real_pages(spark):
    pages = spark.read.parquet(PAGES)
    want = sorted((r["page_id"], r["url"], t := Plain.text(r["html"]), len(t)) for r in pages.collect())
    assert sorted(tuple(r) for r in html_text.extract(pages).collect()) == want


def built(rng):
    """A page and its main text; what surrounds the text is named in only half of the cases."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    para = lambda: " ".join(sentence(rng.randrange(6, 14)) for _ in range(rng.randrange(3, 7)))
    blocks = [("h1", sentence(4))]
    for _ in range(rng.randrange(4, 9)):
        kind = rng.random()
        if kind < 0.15:
            blocks.append(("h2", word()))
        elif kind < 0.3:
            blocks.append(("p", word()))
        blocks.append(("p", para()))
    body = "".join(f"<{t}>{rng.choice(['', '<b>x</b> ', '<a href=/>see</a> '])}{x}</{t}>" for t, x in blocks)
    expected = " ".join(_texts(body))
    menu = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(8))
    named = rng.random() < 0.5
    around = [f"<div{' class=menu' if named else ''}><ul>{menu}</ul></div>", f"<div{' id=cookie-bar' if named else ' class=q7'}>{sentence(7)}</div>"]
    after = [f"<div{' class=copyright' if named else ' class=z'}>{sentence(5)}</div>", "<footer><p>" + para() + "</p></footer>"]
    holder = rng.choice(["article", "main", "div class=body", "section"])
    notice = f"<div class=q8>{sentence(5)}</div>"
    body = rng.choice([body, notice + body, body + notice, notice + body + notice])
    page = f"<html><body><div class='wrap {rng.choice(['', 'has-sidebar', 'with-banner'])}'>{''.join(around)}<{holder}>{body}</{holder.split()[0]}>{''.join(after)}</div></body></html>"
    return page, expected


def _texts(body):
    p = Plain()
    p.inside = 1
    p.feed(body)
    return [" ".join(b.split()) for b in p.blocks if b.split()]


def test_pages_round_a_known_text():
    rng = random.Random(3)
    pages = [built(rng) for _ in range(300)]
    wrong = [(page, text) for page, text in pages if html_text.main_text(page) != text]
    assert not wrong, wrong[0]


def test_the_ratios_decide(monkeypatch):
    rng = random.Random(3)
    pages = [p for p, _ in (built(rng) for _ in range(100))]
    before = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "path_scores", lambda b: (np.ones(len(b.text)), 0.5))
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, before, strict=True)) > 40


@pytest.mark.parametrize("wrapper", ["page has-sidebar", "sidebar-layout", "with-banner", "content-and-comments"])
def test_no_class_word_drops_the_page(wrapper):
    text = "A story of some length, with marks. It goes on for a while, and ends here."
    page = f'<body><div class="{wrapper}"><h1>Head</h1><div><p>{text}</p></div><div class="sidebar"><p>Other, here.</p></div></div></body>'
    assert html_text.main_text(page) == f"Head {text}"
    assert html_text.main_text(f"<main><div class='{wrapper}'><article><p>{text}</p></article></div></main>") == text
    assert html_text.main_text(f"<form id=whole><h1>Head</h1><div><p>{text}</p></div></form>") == f"Head {text}"


def test_unmarked_boilerplate_in_an_article_goes():
    text = " ".join(["A sentence of the story, with marks and a good length."] * 6)
    page = f"<article><div class=k1>We use cookies here.</div><h1>Head</h1><p>{text}</p><p>Short.</p><ul><li>one<li>two</ul><div class=k2>2020 Some Site</div></article>"
    assert html_text.main_text(page) == f"Head {text} Short. one two"


@pytest.mark.parametrize("page", ["<article><p data-x=a don't>One, two.</p><p>Three.</p><p title='x'>Four.</p></article>", "<article><p title=\"a > b\">One, two.</p><p x='>'>Three.</p>Four.</article>"])
def test_stray_quotes(page):
    assert html_text.main_text(page) == "One, two. Three. Four."


@pytest.mark.parametrize(
    ("page", "least"),
    [
        ("<article>" + "<div>" * 100_000 + "<p>Deep, here.</p>" + "</div>" * 5, 11),
        ("<article>" + "<p>Some words, and more. " * 400_000, 8_000_000),
        ("<i><div>" + "<b>" * 50_000 + "x</i>" * 50_000, 50_000),
        ("<span>" * 50_000 + "<div>a</div><li>" * 50_000, 50_000),
        ("<noembed>x" * 50_000, 50_000),
        ("<p x='" * 50_000, 0),
        ("<div class=menu>" * 50_000 + "word", 0),
    ],
)
def test_deep_and_long_pages_in_linear_time(page, least):
    began = time.time()
    assert len(html_text.main_text(page)) >= least
    assert time.time() - began < 30
