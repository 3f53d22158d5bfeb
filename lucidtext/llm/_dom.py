"""Leaf blocks of web pages, with what their ancestors and texts tell.

A tolerant reader: tags open and close blocks, missing end tags are implied, end tags
without a start are ignored, and what scripts, styles and the like hold is no text.
Quotes that never close end at the next ``>``. A page is read once from left to right.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't read as markup, and isn't text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Without text of the page, though their content is markup.
SILENT = frozenset("head template svg math canvas audio video object select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol"
    " optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An end that is implied by a start: tag -> (tags that it closes, tags beyond which nothing is closed).
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
SCOPE = frozenset("table td th caption button".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z][-\w]*)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}

#: Bits of the ancestors. From FIRST_BAD on, they speak against a block.
GROUPS = ("main", "good", "list", "table", "heading", "quote", "label", "nav", "header", "footer", "side", "form", "dialog", "hidden", "ad", "comment", "notice", "widget", "menu", "top", "bottom", "share")
BIT = {g: 1 << k for k, g in enumerate(GROUPS)}
FIRST_BAD = GROUPS.index("nav")
BAD = sum(BIT[g] for g in GROUPS[FIRST_BAD:])

_TAGS = {t: BIT[g] for g, tags in {"main": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "side": "aside", "form": "form fieldset button search", "dialog": "dialog", "list": "ul ol dl", "table": "table", "heading": "h1 h2 h3 h4 h5 h6", "quote": "blockquote pre figure"}.items() for t in tags.split()}
_ROLES = {"main": "main", "article": "main", "navigation": "nav", "menu": "nav", "menubar": "nav", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog"}
_WORDS = {w: BIT[g] for g, words in {
    "good": "article content main post entry story body text",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner anzeige werbung",
    "comment": "comment comments commentlist discussion disqus reply replies respond reactions kommentar kommentare",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay toast announcement warning",
    "widget": "sidebar side widget widgets related recommended recommendations trending popular rail aside more",
    "menu": "nav navi navigation navbar menu menus breadcrumb breadcrumbs crumbs pagination pager toolbar tabs skip toc",
    "top": "header masthead logo topbar",
    "bottom": "footer copyright legal imprint colophon",
    "share": "share sharing social subscribe subscription newsletter signup login follow tags buttons",
}.items() for w in words.split()}


class Block(NamedTuple):
    text: str
    bits: int  #: of all ancestors
    tag: str  #: nearest block's
    link: int  #: characters within links


def _told(tag: str, rest: str) -> int:
    """Bits of a start tag."""
    bits = _TAGS.get(tag, 0)
    if "=" not in rest and "hidden" not in rest:
        return bits
    for name, a, b, c, bare in _ATTRIBUTE.findall(rest):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id"):
            for w in _PART.findall(value):
                bits |= _WORDS.get(w.lower(), 0)
        elif name == "role":
            bits |= BIT.get(_ROLES.get(value.lower(), ""), 0)
        elif name == "itemprop" and value.lower() == "articlebody":
            bits |= BIT["main"]
        elif (name == "hidden" and not value) or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            bits |= BIT["hidden"]
        elif name == "data-label":
            bits |= BIT["label"]
    return bits


class _Reader:
    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag and the state before it: bits, silent, link
        self.open: dict[str, int] = {}
        self.bits, self.silent, self.link = 0, False, False
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                tag = next((t for t, *_ in reversed(self.stack) if t in BLOCK), "")
                self.blocks.append(Block(text, self.bits, tag, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if text and not self.silent:
            self.parts.append(text)
            if self.link:
                self.linked += len(text)

    def pop(self) -> str:
        tag, self.bits, self.silent, self.link = self.stack.pop()
        self.open[tag] -= 1
        return tag

    def close(self, tags: tuple[str, ...], until: tuple[str, ...] | frozenset[str]) -> None:
        """Close the innermost of ``tags`` with all in it, unless one of ``until`` lies between."""
        if any(self.open.get(t) for t in tags):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in tags:
                    while len(self.stack) > k:
                        self.pop()
                    return
                if self.stack[k][0] in until:
                    return

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.close(("p",), SCOPE)
            if tag in IMPLIED:
                self.close(*IMPLIED[tag])
        elif tag == "br":
            self.say(" ")
        if tag in VOID:
            return
        told = _told(tag, rest)
        self.stack.append((tag, self.bits, self.silent, self.link))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.bits |= told
        self.silent = self.silent or tag in SILENT
        self.link = self.link or tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.close((tag,), frozenset() if tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else SCOPE - {tag})
        elif tag == "br":
            self.say(" ")
        else:
            self.close((tag,), BLOCK)


def blocks(html: str) -> tuple[list[Block], str]:
    """Leaf blocks of a page in order, and its title."""
    r, at, title, quotes = _Reader(), 0, "", True
    end = len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            r.say(html[at:])
            break
        if lt > at:
            r.say(html[at:lt])
        if html.startswith("<!--", lt):
            at = html.find("-->", lt + 4)
            at = end if at < 0 else at + 3
            continue
        m = _NAME.match(html, lt)
        if m is None:
            if html.startswith(("<!", "<?", "</"), lt):
                at = html.find(">", lt) + 1 or end
            else:
                r.say("<")
                at = lt + 1
            continue
        rest = _REST.match(html, m.end()) if quotes else None
        if rest is not None:
            at = rest.end()
        else:  # a quote that never closes: from here on, tags end at the next >
            quotes = False
            at = html.find(">", m.end()) + 1 or end
        tag = m[1].lower()
        if html[lt + 1] == "/":
            r.end(tag)
        elif tag in RAW:
            stop = _ENDS[tag].search(html, at)
            if tag == "title" and not title and stop:
                title = " ".join(unescape(html[at : stop.start()]).split())
            at = (html.find(">", stop.end()) + 1 or end) if stop else end
        else:
            r.start(tag, html[m.end() : at])
    r.flush()
    return r.blocks, title
