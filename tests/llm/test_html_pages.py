"""Main text of pages with and without containers, of unclosed, deep and oddly named elements."""

from html.parser import HTMLParser

import pytest
from corvane.llm import html

LONG = "This is a text of the valley, and it is long enough to be good by the words that are in it and in all of its parts."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<head><title>t</title><meta charset=x><body><article><p>{LONG}</p></article>", LONG),
        (f"<html><head><title>t</title><p title='the hidden valley'>{LONG}", LONG),
        (f"<div data-id='share' data-class='ad'><p>{LONG}</p></div>", LONG),
        (f"<div class='content has-sidebar'><article><p>{LONG}</p><p>Short.</p></article></div>", f"{LONG}\nShort."),
        (f"<div id='page-header-layout'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='sidebar'><article><p>Own text.</p></article></div><div class='intro'><p>{LONG}</p></div>", "Own text."),
        (f"<article><p>{LONG}</p></article><div class='related'><article><p>Another one.</p></article></div>", LONG),
        (f"<div class='banner'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        ("<div>" * 600 + f"<p>{LONG}</p>" + "</div>" * 600 + f"<div class='sidebar'><p>{LONG}</p></div>", LONG),
        ("<article>" + "<div>" * 600 + "</div>" * 600 + f"<p>{LONG}</p></article><p>{LONG}</p>", LONG),
        (f"<article><p>a <button>x</button> b<svg><title>s</title></svg> c<script src=x/>var a='<p>';</script><p title='a > b'>d</article>", "a b c\nd"),
        (f"<article><header><h1>Title</h1></header><div class='article-header'>Under it</div><figure><img><figcaption>Caption</figcaption></figure><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", f"Title\nUnder it\nCaption\n{LONG}"),
        ("<div><p>吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。</p></div>", "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。"),
        ("<p>Dette er en lang norsk tekst som handler om været i dag, og den er lang nok til å være god etter reglene vi har.", "Dette er en lang norsk tekst som handler om været i dag, og den er lang nok til å være god etter reglene vi har."),
        ("<p>Tämä on pitkä suomenkielinen teksti joka kertoo säästä tänään. Se on riittävän pitkä ollakseen hyvä sääntöjen mukaan.", "Tämä on pitkä suomenkielinen teksti joka kertoo säästä tänään. Se on riittävän pitkä ollakseen hyvä sääntöjen mukaan."),
        (f"<h2>Heading</h2><p>{LONG}</p><ul><li><a href=1>One link and its long enough words for a block of text that is only a link</a><li><a href=2>b</a></ul>", f"Heading\n{LONG}"),
        (f"<p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore</p><p>{LONG}</p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


def test_density_decides_in_containers_too():
    by = [(b.label, b.by) for b in html.classify(f"<article><p>{LONG}</p><p>So.</p><p><a href=1>{LONG}</a></p><p>Oh.</p><p><a href=2>{LONG}</a></p></article>")]
    assert by == [("good", "density"), ("good", "neighbours"), ("bad", "links"), ("bad", "neighbours"), ("bad", "links")]


def test_long_and_deep_pages_are_read_whole():
    n = 30000
    page = "<div>" * n + "</span></b>" * n + "</section>" * n + f"<p>{LONG}" + f"<p>{LONG}" * 5000
    assert html.extract(page).count("\n") == 5000


class Reading(HTMLParser):
    """The text in <article>, cut at its paragraphs and headings, by the library's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.blocks = False, [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if self.inside and text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.cut()
            self.inside = self.inside or tag == "article"
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.parts.append(data)


def test_query_equals_an_independent_reading(spark):
    """The tables' pages have one article without links or marked elements in it."""
    from corvane.llm.queries import op2_html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op2_html(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        reading = Reading()
        reading.feed(pages[r["page_id"]] or "")
        reading.close()
        reading.cut()
        assert r["text"] == "\n".join(reading.blocks) and r["n_chars"] == len(r["text"])
        without = html.classify((pages[r["page_id"]] or "").replace("article>", "div>"))
        assert not any(b.label == "good" and b.text not in reading.blocks for b in without)


def test_rows_with_clashing_columns(spark):
    rows = [(1, "u", f"<p>{LONG}", 1, "t", "h"), (1, "u", f"<p>{LONG}", 1, "t", "h"), (None, None, None, None, None, None), (2, None, "", 3, "k", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string, k string")
    got = html.extract_pages(frame).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, LONG), (1, LONG), (2, "")]
    assert html.extract_pages(frame.limit(0)).collect() == []
