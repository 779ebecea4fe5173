"""Main-text extraction from HTML by two-pass block rules.

One pass over the markup cuts a page into blocks and keeps, for each, the element it lies in. Elements that are never
main text by their kind (navigation, footers, asides, forms, hidden ones) exclude their blocks. Words of class
and id are a weaker sign: they exclude too, but not if they name a layout ("has-sidebar"), and not an element that
holds the page's only article-like container, or all there is of main text. Then

pass 1 labels blocks by stop-word density, length and link density, in a container as elsewhere: ``bad`` (excluded, or
mostly links), ``good`` (long with many stop words, or long and prose by its sentence marks in a language without a list),
``bad`` again (long, few stop words in a page of a known language, outside a container), or undecided;
pass 2 gives each undecided block the label of its nearest decided neighbours. Outside a container both
neighbours must be good, or the nearer one, a heading goes with what follows, and a long block goes only between two bad ones; inside one, neighbours beyond its borders don't count, the
container itself speaks for its blocks, and only blocks between two bad ones go.

Density is the share of a block's words in the best of a dozen languages' short lists, joined by words that the page
itself uses as such (short ones that recur across its blocks); in scripts without word spaces it is the share of function characters.

A page with an article-like container keeps nothing from outside it. Character references are decoded, white
space inside a block becomes one space, blocks are joined by one newline in page order. Null or empty html
gives an empty text; pages cut off anywhere, unclosed elements and any depth are read as far as they go, in time linear in the page.
Every row gives one row, repeated ones too; an empty table gives an empty one. Only the key and the columns in ``keep``
pass; other columns, whatever their names (text, n_chars), play no part, but ``keep`` itself can't hold text or n_chars.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches, prepare

LANGUAGES = {
    "en": "the of and to in a is that it was for on are as with be by at this have from or had not but what all were when we there can an which their if will each about up out them then she many some so these would into has more her two him see could no make than been its now did get may he his they you i our who do my",
    "fr": "de la le les et des en un une du dans est que qui pour pas sur au aux par plus ne se ce il elle sont avec son sa ses ou mais nous vous ont été être cette leur comme tout fait on lui y je à d l",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich wir",
    "es": "de la el que y en los se del las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso es ha si son dos fue había era años está qué sólo han yo",
    "it": "di e il la che in a per è un non una del con si da sono le dei nel al come più ma della lo gli anche i alla delle ha su o se questo ci nella dal era suo",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als bij dan maar door nog naar uit of hij worden wordt heeft over tot deze die ze ik je was",
    "no": "og i det er på som en et til av for at med de ikke den har om var jeg men så fra kan vi han hun seg ble eller skal være etter ved også sin hadde du der når år",
    "sv": "och i att det som en på är av för med den till inte har de ett om men var jag så från kan vi han hon sig eller ska efter vid också sin hade du där när år",
    "pl": "i w na z do się nie że jest to o jak po ale za od a co przez przy dla tym tego był być które który oraz są już tak jego",
    "ru": "и в не на я что он с по это как но к у же из за от бы то а так о был его для мы они она до вы при или если ещё было только все",
    "tr": "ve bir bu da de için ile olarak çok daha o ne gibi olan en kadar sonra var ama ya ki mi değil her ise",
}
#: Word -> a one at the place of each language that has it, 32 bits apart, so that sums count for all languages at once.
STOP: dict[str, int] = {}
for _i, _words in enumerate(LANGUAGES.values()):
    for _w in set(_words.split()):
        STOP[_w] = STOP.get(_w, 0) | 1 << 32 * _i
#: Function characters of scripts that don't put spaces between words.
_NO_SPACES = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_FUNCTION = re.compile("[ぁ-ゖ的一是不了在有我他这為为和个中上大到说就也]")
_SENTENCE = re.compile(r"[.!?…。！？।؟۔။](?:[\s\"'”’»)]|$)|[。！？]")
#: Text up to the end tag, or to the end of the page, as browsers have it.
RAW = "script|style|noscript|template|iframe|textarea|title|xmp"
#: Left out without cutting the block around them, if they are closed.
LEFT_OUT = "svg|select|button|object|math|canvas|audio|video|map"
EXCLUDED_TAGS = frozenset("nav footer aside form menu dialog fieldset head svg select button object math canvas audio video map".split())
IN_HEAD = frozenset("meta link base basefont bgsound".split())
CONTAINERS = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input ins del kbd label link mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert warning newsletter subscribe subscription signup popup modal overlay paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share sharing social footer header masthead comment comments commentlist disqus reply replies responses respond discussion form login search pagination pager copyright legal disclaimer toolbar skip".split()
)
#: In a container these head the article itself.
OWN_HEADERS = frozenset(("header", "masthead", "banner"))
#: Words that make a class name one of a layout, of what is around and not of what is inside.
LAYOUT = frozenset("has have with without no not is layout page wrapper wrap container grid body main content site".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<({LEFT_OUT})\b(?:[^>"']|"[^"]*"|'[^']*')*(?:/>|>.*?</\2\s*>)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[/!?][^>]*(?:>|\Z)|([^<]+)|<""", re.S | re.I)
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_HEADING = re.compile("h[1-6]")


@dataclass
class Block:
    text: str
    link: int
    element: int
    heading: bool
    hidden: bool  # by the paragraph's own attributes
    excluded: bool = False
    inside: int = 0  # number of the container; 0 outside any
    density: float = 0.0
    label: str = ""
    by: str = ""  # what decided: tag, hint, links, density, sentences, container, neighbours


@dataclass
class Element:
    tag: str
    parent: int
    hard: bool
    hint: bool
    own: bool  # article-like


def signs(attrs: str, own: bool = False) -> tuple[bool, bool, bool]:
    """Of an element's attributes: whether they exclude it, hint that it isn't main text, and say that it is the article's body."""
    hard = hint = body = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for token in value.split():
                parts = [x.lower() for x in _CAMEL.split(token) if x]
                hint = hint or (bool(parts) and not LAYOUT.intersection(parts) and any(x in HINTS and not (own and x in OWN_HEADERS) for x in (parts[0], parts[-1])))
        elif name == "role":
            hard = hard or value.lower() in ROLES
            body = body or value.lower() in ("main", "article")
        elif name == "itemprop":
            body = body or value == "articleBody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            hard = True
    return hard, hint, body


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks and elements, in order; element 0 is the page."""
    out: list[Block] = []
    elements = [Element("", 0, False, False, False)]
    stack, opened = [0], Counter()
    parts: list[str] = []
    linked, link, hidden, heading = 0, False, False, False
    held = [False]  # whether the element at each place of the stack is in a container

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, stack[-1], heading, hidden))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        for e in stack[at:]:
            opened[elements[e].tag] -= 1
        del stack[at:], held[at:]

    for m in _TOKEN.finditer(html):
        if (text := m[6]) is not None:
            parts.append(text)
            if link:
                linked += len(text)
            continue
        if (tag := m[4]) is None:
            if m[0] == "<":
                parts.append("&lt;")
            elif m[1] or m[2]:
                parts.append(" ")
            continue
        tag, closing, attrs = tag.lower(), bool(m[3]), m[5]
        if opened["head"] and not (closing or tag in IN_HEAD):  # its end tag may be left out
            flush()
            close(max(i for i, e in enumerate(stack) if elements[e].tag == "head"))
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        link = False
        if tag in ("p", "hr") or _HEADING.fullmatch(tag):
            hidden = not closing and bool(attrs) and any(signs(attrs, held[-1])[:2])
            heading = not closing and tag[0] == "h" and tag != "hr"
            continue
        hidden = heading = False
        if tag in VOID:
            continue
        if closing:
            if opened[tag] > 0:
                at = len(stack) - 1
                while elements[stack[at]].tag != tag:
                    at -= 1
                close(at)
            continue
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and elements[stack[-1]].tag == tag:  # their end tags may be left out
            close(len(stack) - 1)
        hard, hint, body = signs(attrs, held[-1]) if attrs else (False, False, False)
        own = tag in CONTAINERS or (body and tag not in EXCLUDED_TAGS)
        hard = (hard and not (own and tag in CONTAINERS)) or tag in EXCLUDED_TAGS or (tag == "header" and not held[-1])
        if tag in ("html", "body"):
            hard = hint = False
        elements.append(Element(tag, stack[-1], hard, hint and not (own and tag == "main"), own))
        stack.append(len(elements) - 1)
        held.append(held[-1] or own)
        opened[tag] += 1
    flush()
    return out, elements


def place(found: list[Block], elements: list[Element], ignored: frozenset[int] = frozenset()) -> None:
    """Say of each block whether it is excluded and which container holds it; hints of ``ignored`` elements don't count."""
    excluded, inside, containers = [False] * len(elements), [0] * len(elements), 0
    for i, e in enumerate(elements[1:], 1):
        excluded[i] = excluded[e.parent] or e.hard or (e.hint and i not in ignored)
        inside[i] = inside[e.parent]
        if e.own and not excluded[i] and not inside[i]:
            containers += 1
            inside[i] = containers
    for b in found:
        b.excluded, b.inside = excluded[b.element] or b.hidden, inside[b.element]
        b.label = b.by = ""


def around(element: int, elements: list[Element]) -> list[int]:
    out = []
    while element:
        out.append(element)
        element = elements[element].parent
    return out


def overruled(found: list[Block], elements: list[Element], containers: bool) -> frozenset[int]:
    """Hinted elements around what is most of a page's main text: around the container with most text, or those with over half of the page's."""
    hard, size = [False] * len(elements), [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        hard[i] = hard[e.parent] or e.hard
    for b in found:
        if not hard[b.element]:
            size[b.element] += len(b.text) - b.link
    for i in range(len(elements) - 1, 0, -1):
        size[elements[i].parent] += size[i]
    if containers:
        own = max((i for i, e in enumerate(elements) if e.own and not hard[i] and size[i]), key=lambda i: size[i], default=0)
        return frozenset(i for i in around(own, elements) if elements[i].hint)
    return frozenset(i for i, e in enumerate(elements) if e.hint and 2 * size[i] > size[0])


def most(hits: int) -> int:
    """The count of the language with most hits."""
    return max(hits >> 32 * i & 0xFFFFFFFF for i in range(len(LANGUAGES))) if hits else 0


def densities(found: list[Block]) -> bool:
    """Set the blocks' densities; whether the page's language has a list, or is written without word spaces."""
    words = [[] if b.excluded else _WORDS.findall(b.text.lower()) for b in found]
    spread = Counter(w for b, own in zip(found, words) if not b.excluded and 2 * b.link <= len(b.text) for w in set(own) if len(w) < 5)
    recurring = {w for w, n in spread.items() if n >= 3 and 4 * n >= len(found) and w not in STOP}
    best, of = 0.0, sum(len(w) for b, w in zip(found, words) if not b.excluded)
    total = 0
    for b, own in zip(found, words):
        packed = len(_NO_SPACES.findall(b.text))
        if 3 * packed > len(b.text):
            b.density = 1.5 * len(_FUNCTION.findall(b.text)) / packed
            best = max(best, b.density)
            continue
        if b.excluded:
            continue
        hits = sum(STOP.get(w, 0) for w in own)
        total += hits
        more = sum(w in recurring for w in own) if recurring else 0
        b.density = (most(hits) + more) / len(own) if own else 0.0
    return max(best, most(total) / of if of else 0.0) >= 0.22


def first_pass(b: Block, known: bool, least: int, most_links: float, stop_high: float, stop_low: float) -> None:
    """good, bad, or "" for a block that its neighbours decide."""
    n = len(b.text)
    if b.excluded:
        b.label, b.by = "bad", "tag"
    elif b.link > most_links * n:
        b.label, b.by = "bad", "links"
    elif n < least and not (_NO_SPACES.search(b.text) and 2 * n >= least):
        return
    elif b.density >= stop_high:
        b.label, b.by = "good", "density"
    elif not known and _SENTENCE.search(b.text):
        b.label, b.by = "good", "sentences"
    elif known and b.density < stop_low and not b.inside:
        b.label, b.by = "bad", "density"


def nearest(speaks: list[bool]) -> list[tuple[int, int]]:
    """The nearest places before and after each that speak; -1 for none."""
    n = len(speaks)
    before, after, last = [-1] * n, [-1] * n, -1
    for i in range(n):
        before[i] = last
        last = i if speaks[i] else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if speaks[i] else last
    return list(zip(before, after))


def second_pass(found: list[Block], least: int) -> None:
    """Undecided blocks take the label of their nearest decided neighbours."""
    # an advert or form amid an article says nothing of the paragraphs around it, nor a menu of a long block beside it
    short = nearest([bool(b.label) and not (b.inside and b.excluded) for b in found])
    long = nearest([bool(b.label) and not b.excluded for b in found])
    decided = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label:
            continue
        large = len(b.text) >= least
        sides = (long if large else short)[i]
        near = [(abs(j - i), decided[j]) for j in sides if j >= 0 and found[j].inside == b.inside]
        b.by = "neighbours" if near else "container" if b.inside else "alone"
        if b.inside or large:
            b.label = "bad" if len(near) == 2 and all(x == "bad" for _, x in near) and not b.heading else "good"
        elif not near:
            b.label = "bad"
        elif b.heading and sides[1] >= 0:  # a heading goes with what it heads
            b.label = decided[sides[1]]
        else:
            nearer = min(d for d, _ in near)
            b.label = "good" if all(x == "good" for d, x in near if d == nearer) else "bad"


def classify(html: str, *, least: int = 70, most_links: float = 0.5, stop_high: float = 0.3, stop_low: float = 0.15) -> list[Block]:
    """The page's blocks with their labels, and what decided them; those of main text are good."""
    found, elements = blocks(html)

    def decide(ignored: frozenset[int]) -> bool:
        place(found, elements, ignored)
        known = densities(found)
        for b in found:
            first_pass(b, known, least, most_links, stop_high, stop_low)
        second_pass(found, least)
        return any(b.label == "good" for b in found)

    ignored: frozenset[int] = frozenset()
    place(found, elements)
    if not any(b.inside and not b.excluded for b in found) and any(e.own for e in elements):
        ignored = overruled(found, elements, True)
    if not decide(ignored) and any(e.hint for e in elements):
        decide(ignored | overruled(found, elements, False))
    if any(b.inside and b.label == "good" for b in found):
        for b in found:
            if not b.inside and b.label == "good":
                b.label, b.by = "bad", "container"
    return found


def extract(html: str | None, **rules: float) -> str:
    """The main text of a page; "" if there is none."""
    return "\n".join(b.text for b in classify(html, **rules) if b.label == "good") if html else ""


def extract_pages(pages: DataFrame, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), **rules: float) -> DataFrame:
    """key, the columns in ``keep``, text string and n_chars long (code points), a row for each page."""
    prepare(pages.sparkSession)
    src = pages.select(F.col(key).alias("k"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(html).alias("h"))
    kept = [f for f in src.schema.fields if f.name != "h"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, **rules) for h in batch.column("h").to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*[f.name for f in kept], "text", "n_chars"])

    out = map_batches(src, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", text string, n_chars long")
    return out.toDF(key, *keep, "text", "n_chars")
