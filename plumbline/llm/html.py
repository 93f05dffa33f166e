"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. A word scores positive, a tag negative; how much is learned from
labelled pages: each element above a word contributes the log odds, over the labelled pages, that words below such an
element (its name, the parts of its class, id and role) belong to the article, and a tag's penalty grows with the share
of such tags that stand outside of articles. Words below an element whose odds speak against it score negative, unless
that element lies in a container that speaks for the article: there they score nothing, so that an advert between two
paragraphs doesn't part them. One linear scan finds the best contiguous region; its words, without those below an element
that speaks against it, are the text.

Blocks are the text between block-level tags; inline tags don't part words, line breaks and references to spaces do.
Character references are decoded once, white space in a block becomes one space, blocks are trimmed and joined by one
line end. Null, empty and word-less pages give an empty text. Pages are independent rows: no shuffle; memory is a page.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile(r"--!?>")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
# Fixed values of HTML: elements whose content is not markup, without end tag, and of the text flow.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "select", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "details", "dialog", "fieldset", "menu", "blockquote", "button", "center", "address", "p", "li"}
CLOSES_P = CONTAINERS - {"html", "head", "body", "button", "li"} | {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr"}

#: Labelled pages: the article's words are those in <main-text> (a mark that is removed before the page is read).
_CHROME = (
    "nav;ul class=menu;div class=navbar;div class=navigation;div class=breadcrumbs;div class=breadcrumb;div role=navigation;div id=menu;div id=nav;div class=topbar;div class=toolbar;header;div class=header;div id=header;div class=masthead;div role=banner;div class=banner;"
    "aside;div class=sidebar;div id=sidebar;div class=side;div class=widget;div class=related;div class=recommended;div class=trending;div class=popular;div role=complementary;div class=ad;div class=ads;div class=advert;div class=adverts;div class=advertisement;div id=ad;div class=sponsor;div class=sponsored;div class=promo;div class=promotion;"
    "div class=cookie;div class=cookies;div class=consent;div class=gdpr;div class=notice;div class=notices;div class=alert;div class=popup;div class=modal;div class=overlay;dialog;div class=paywall;div class=disclaimer;form;div class=form;div class=newsletter;div class=subscribe;div class=subscription;div class=signup;div class=login;div class=search;div role=search;button;"
    "footer;div class=footer;div id=footer;div role=contentinfo;div class=copyright;div class=legal;div class=comments;div id=comments;section class=comments;div class=comment;ol class=commentlist;div class=disqus;div class=respond;div class=replies;div class=reply;div class=share;div class=sharing;div class=social;div class=pagination;div class=pager;div class=skip;head;menu"
).split(";")
_ROOTS = "article;main;div role=main;div class=article;div class=content;div class=post;div class=entry;div id=content;div class=main;div class=story".split(";")


def labelled_pages() -> list[str]:
    """One page for each kind of article container, with every kind of chrome around it and some inside."""

    def element(spec: str, inner: str) -> str:
        return f"<{spec}>{inner}</{spec.split()[0]}>"

    pages = []
    for k, root in enumerate(_ROOTS):
        chrome = [element(c, "<a>one</a> two three") for c in _CHROME]
        paragraphs = "<h1>four five</h1><p>six <b>seven</b> <a>eight</a> nine<br>ten</p><h2>eleven</h2><p>twelve <i>and</i></p><ul><li>more</li></ul><blockquote>words</blockquote><table><tr><td>cell</td></tr></table>"
        within = f"<main-text>{paragraphs}</main-text>{chrome[(7 * k) % len(chrome)]}<main-text>{paragraphs}</main-text>"
        pages.append(f"<html>{''.join(chrome[: len(chrome) // 2])}{element(root, within)}{''.join(chrome[len(chrome) // 2 :])}</html>")
    return pages


def features_of(name: str, attributes: str) -> list[str]:
    out = [name]
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            out += [f".{x}" for x in PART.findall((m[2] or m[3] or m[4] or "").lower())]
    return out


class Weights:
    """Learned from labelled pages: ``against`` and ``for_`` (features by log odds) and the penalty of each tag."""

    WORD, OUTSIDE = 1.0, -1.0
    #: The penalty of tags in a container that speaks for the article.
    NESTED = 0.01

    def __init__(self, pages: list[str]) -> None:
        inside, outside, tags = defaultdict(int), defaultdict(int), defaultdict(lambda: [0, 0])
        for page in pages:
            above: list[tuple[str, list[str]]] = []
            main = False
            for kind, name, attributes, text in sequence(page):
                if name == "main-text":
                    main = kind == "open"
                elif kind == "text":
                    for f in {f for _, fs in above for f in fs}:
                        (inside if main else outside)[f] += len(text.split())
                else:
                    tags[name][not main] += 1
                    if kind == "open" and name in CONTAINERS:
                        above.append((name, features_of(name, attributes)))
                    elif kind == "close" and any(n == name for n, _ in above):
                        while above.pop()[0] != name:
                            pass
        odds = {f: math.log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in {*inside, *outside} - {"html", "body", "div", "section", "p", "ul", "ol", "li"}}
        self.against = {f for f, w in odds.items() if w < -1}
        self.for_ = {f for f, w in odds.items() if w > 1}
        self.penalty = {t: 0.05 + 0.45 * out / (inn + out) for t, (inn, out) in tags.items()}


class Ends:
    """Where tags of a page end, in time linear in the page: what was searched in vain once isn't searched again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.vain: dict[str, int] = {}  # of a text, the first place after which it is known not to come
        self.failed: set[int] = set()  # places outside of quotes from which no tag ends

    def find(self, what: str, at: int) -> int:
        if at >= self.vain.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.vain[what] = at
        return found

    def of_tag(self, at: int) -> int:
        """The place after the ``>`` that ends a tag, quoted values skipped; -1 without one."""
        passed = []
        while at not in self.failed:
            passed.append(at)
            if self.find(">", at) < 0:
                break
            m = STOP.search(self.page, at)  # there is one
            if m[0] == ">":
                return m.end()
            close = self.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.failed.update(passed)
        return -1


def sequence(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(open | close | text, tag name, attributes, text)"""
    at, n, text, ends = 0, len(page), 0, Ends(page)
    while m := TAG.search(page, at):
        if m[1]:
            begin = m.end()
            if page.startswith((">", "->"), begin):
                end = page.index(">", begin) + 1
            else:
                found = COMMENT_END.search(page, begin)
                end = found.end() if found else n
        elif m[2]:
            end = ends.find(">", m.end()) + 1
        else:
            end = ends.of_tag(m.end())
        if end <= 0:  # not a tag: its first character is text
            at = m.start() + 1
            continue
        if m.start() > text:
            yield "text", "", "", page[text : m.start()]
        at = text = end
        if m[4] is None:
            continue
        name = m[4].lower()
        if m[3]:
            yield "close", name, "", ""
            continue
        attributes = page[m.end() : end - 1]
        yield "open", name, attributes, ""
        if name in RAW and not attributes.endswith("/"):
            found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            close = ends.find(">", found.end()) if found else -1
            at = text = close + 1 if close >= 0 else n
            yield "close", name, "", ""
    if text < n:
        yield "text", "", "", page[text:]


def main_blocks(page: str, weights: Weights) -> list[str]:
    """The blocks of the best region."""
    #: what stands above: (element, 1: for the article, -1: against it, 0: neither)
    above: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()  # names above
    against = roots = 0
    best, best_from, best_to = 0.0, 0, 0
    score, start = 0.0, 0
    items: list[str | None] = []  # text to keep, or None at the end of a block
    for kind, name, attributes, text in sequence(page):
        if kind == "text":
            if text.isspace():
                if not against:
                    items.append(text)
                continue
            words = len(text.split())
            if against:
                gain = 0.0 if roots else Weights.OUTSIDE * words
            else:
                gain = Weights.WORD * words
                items.append(text)
        else:
            gain = -(Weights.NESTED if roots else weights.penalty.get(name, 0.25))
            if name == "br" or name == "wbr":
                if name == "br" and not against:
                    items.append(" ")
            elif name not in INLINE and (not items or items[-1] is not None):
                items.append(None)
            if kind == "open" and name == "p" or kind == "open" and name in CLOSES_P:
                if above and above[-1][0] == "p":
                    x, side = above.pop()
                    open_[x] -= 1
                    against -= side < 0
                    roots -= side > 0
            if kind == "open" and name in CONTAINERS:
                own = features_of(name, attributes)
                if name in weights.against and not (name == "header" and roots) or any(f in weights.against for f in own[1:]):
                    side = -1
                else:
                    side = int(any(f in weights.for_ for f in own) and not against)
                above.append((name, side))
                open_[name] += 1
                against += side < 0
                roots += side > 0
            elif kind == "close" and open_[name]:
                while True:
                    x, side = above.pop()
                    open_[x] -= 1
                    against -= side < 0
                    roots -= side > 0
                    if x == name:
                        break
        if score <= 0:
            score, start = 0.0, len(items) - (kind == "text" and not against)
        score += gain
        if score > best:
            best, best_from, best_to = score, start, len(items)
    blocks, own = [], []
    for x in [*items[best_from:best_to], None]:
        if x is not None:
            own.append(x)
        elif own:
            block = " ".join(references.unescape("".join(own)).split())
            if block:
                blocks.append(block)
            own = []
    return blocks


def extract_main_text(pages: DataFrame, *, labelled: list[str] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the blocks of the main text. labelled: pages as labelled_pages() writes them."""
    weights = Weights(labelled_pages() if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = pa.array([main_blocks(x.as_py() or "", weights) for x in batch.column(2)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blocks], names=["page_id", "url", "blocks"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, blocks array<string>")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    text = F.array_join("blocks", "\n")
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
