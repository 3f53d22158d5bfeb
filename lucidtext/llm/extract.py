"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each block has features of its ancestors (which tags and which words in their classes)
and of its text; labels of neighbours depend on each other. Viterbi's best sequence of
a page decides which blocks are its main text.

Training pages come from the table itself, a sample of about ``TRAIN_PAGES`` by chance
of a fixed seed. A page that marks its article tells which blocks are the article; its
texts are also laid out anew in other ways (``layouts``), with the places known, where
the tags are missing or misleading: notices, sidebars, forms and comments within the
article, articles without tags. Some pages of prose of our own are added, so that a
table without any marked article gets a model too. The sample, as feature bits, is a
written table; each step of the training sums the gradients of its partitions, and only
the weights (fewer than a hundred) pass through the driver.

A null page is empty; an empty page has no text. Repeated rows give the same text each.
Blocks keep their order; white space, as Python's str.split knows it, becomes one space.
A break within a block is white space. An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _dom
from ._dom import BAD, BIT, Block, blocks
from ._shared import bound_batches, columns, table, written

TRAIN_PAGES = 2_000
#: Longer pages aren't trained on.
TRAIN_BLOCKS = 2_000
STEPS = 50
RIDGE = 1e-3
SEED = 20240613

#: Words that pages say in what isn't their main text, by kind, in lower case.
_SAID = re.compile(
    r"(cookie|consent|datenschutz|privacy|confidentialit|privacidad|javascript|browser)|(subscribe|newsletter|sign up|log ?in|share|tweet|follow us|anmelden|teilen|abonn|partager|compartir|suscr)"
    r"|(advert|sponsor|anzeige|werbung|publicit|publicidad)|(comment|reply|kommentar|antworten|répondre|responder)|(related|read more|mehr lesen|weiterlesen|lire aussi|leer más|more from)"
    r"|(©|\(c\)|all rights reserved|alle rechte|tous droits|todos los derechos|copyright)|([|·»›•«‹/])|(@|http|www\.)"
)
#: Characters of a block, from its beginning, that are searched for these words and for digits.
_LOOK = 300
_DIGIT = re.compile("[0-9]")
_STOPS = frozenset(".!?…:")
_LEAVES = {t: k for k, tags in enumerate(("p", "li dd dt", "td th caption", "h1 h2 h3 h4 h5 h6", "blockquote pre", "figcaption", "button option label legend summary")) for t in tags.split()}
_LENGTHS, _SHARES = (2, 5, 10, 20, 40, 80), (0.0, 0.3, 0.7)

#: Features: a name for each bit.
NAMES = [
    *_dom.GROUPS, "bad", "main and bad", "main, not bad", "good, not bad", "bare",
    *(f"leaf {k}" for k in range(8)), *(f"words {k}" for k in range(len(_LENGTHS) + 1)), *(f"link {k}" for k in range(len(_SHARES) + 1)),
    "stop", "stops inside", "digits", "capital", "title", *(f"said {k}" for k in range(1, _SAID.groups + 1)),
    "first", "last", "begin", "end", "one", "short before", "long before", "short after", "long after",
]
_AT = {n: k for k, n in enumerate(NAMES)}
SIZE = len(NAMES)


def features(pages: list[tuple[list[Block], str]]) -> tuple[np.ndarray, np.ndarray]:
    """blocks x features (0 or 1) of pages (blocks, title), one after the other, and how many blocks each has."""
    sizes = np.fromiter((len(found) for found, _ in pages), np.int64, len(pages))
    every = [b for found, _ in pages for b in found]
    n = len(every)
    x = np.zeros((n, SIZE), np.uint8)
    if not n:
        return x, sizes
    bits = np.fromiter((b.bits for b in every), np.int64, n)
    x[:, : len(_dom.GROUPS)] = bits[:, None] >> np.arange(len(_dom.GROUPS)) & 1
    x[:, _AT["label"]] = 0
    bad, main, good = bits & BAD > 0, bits & BIT["main"] > 0, bits & BIT["good"] > 0
    for name, is_so in (("bad", bad), ("main and bad", main & bad), ("main, not bad", main & ~bad), ("good, not bad", good & ~bad), ("bare", ~(bad | main | good))):
        x[:, _AT[name]] = is_so
    words, chars, link, leaf = (np.fromiter(v, np.int64, n) for v in ((b.text.count(" ") + 1 for b in every), (len(b.text) for b in every), (b.link for b in every), (_LEAVES.get(b.tag, 7) for b in every)))
    rows = np.arange(n)
    x[rows, _AT["leaf 0"] + leaf] = x[rows, _AT["words 0"] + np.searchsorted(_LENGTHS, words)] = 1
    x[rows, _AT["link 0"] + (link[:, None] > np.asarray(_SHARES) * chars[:, None]).sum(1)] = 1
    stop, inside, digits, capital, same, said = (_AT[name] for name in ("stop", "stops inside", "digits", "capital", "title", "said 1"))
    on: list[tuple[int, int]] = []
    i = 0
    for found, title in pages:
        for b in found:
            text = b.text
            if text[-1] in _STOPS or text.rstrip("\"'»”’)")[-1:] in _STOPS:
                on.append((i, stop))
            if ". " in text or "? " in text or "! " in text:
                on.append((i, inside))
            if text[0].isupper():
                on.append((i, capital))
            if title and (title.startswith(text) or text.startswith(title)):
                on.append((i, same))
            look = text[:_LOOK].lower()
            if 10 * len(_DIGIT.findall(look)) > 3 * len(look):
                on.append((i, digits))
            for m in _SAID.finditer(look):
                on.append((i, said - 1 + m.lastindex))
            i += 1
    if on:
        x[tuple(np.array(on).T)] = 1
    some = sizes[sizes > 0]
    ends = np.cumsum(some)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - some] = last[ends - 1] = True
    place = (rows - np.repeat(ends - some, some) + 0.5) / np.repeat(some, some)
    x[:, _AT["first"]], x[:, _AT["last"]], x[:, _AT["begin"]], x[:, _AT["end"]], x[:, _AT["one"]] = first, last, place < 0.2, place > 0.8, 1
    x[1:, _AT["short before"]], x[1:, _AT["long before"]] = ~first[1:] & (words[:-1] <= 3), ~first[1:] & (words[:-1] > 15)
    x[:-1, _AT["short after"]], x[:-1, _AT["long after"]] = ~last[:-1] & (words[1:] <= 3), ~last[:-1] & (words[1:] > 15)
    return x, sizes


class Field:
    """Weights of the features for a block of main text, and of the four pairs of neighbouring labels."""

    def __init__(self, theta: np.ndarray) -> None:
        self.theta = theta
        self.pairs = theta[SIZE:].reshape(2, 2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x @ self.theta[:SIZE]

    def gradient(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the log-likelihood of the labels of pages, one after the other with ``sizes`` blocks each, by forward and backward sums; and the log-likelihood."""
        order = np.argsort(-sizes, kind="stable")  # at each place, the pages that have a block there come first
        at, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        on = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # pages with a block at each place
        e = self.emissions(x)
        score = np.stack([np.zeros(len(e)), e], 1)
        ahead, back = score.copy(), np.zeros((len(e), 2))
        for t in range(1, len(on)):
            k = at[: on[t]] + t
            ahead[k] += np.logaddexp(ahead[k - 1, :1] + self.pairs[0], ahead[k - 1, 1:] + self.pairs[1])
        for t in range(len(on) - 2, -1, -1):
            k = at[: on[t + 1]] + t
            onwards = score[k + 1] + back[k + 1]
            back[k] = np.logaddexp(onwards[:, :1] + self.pairs[:, 0], onwards[:, 1:] + self.pairs[:, 1])
        ends = at + size - 1
        total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
        of = np.empty(len(e))
        of[np.concatenate([np.arange(a, a + m) for a, m in zip(at, size, strict=True)])] = np.repeat(total, size)
        share = np.exp(ahead[:, 1] + back[:, 1] - of)
        out = np.zeros(SIZE + 4)
        out[:SIZE] = (y - share) @ x
        inner = np.ones(len(e), bool)
        inner[ends] = False
        k = np.flatnonzero(inner)
        both = np.exp(ahead[k][:, :, None] + self.pairs + (score[k + 1] + back[k + 1])[:, None, :] - of[k][:, None, None])
        seen = np.bincount(y[k] * 2 + y[k + 1], minlength=4)
        out[SIZE:] = seen - both.sum(0).ravel()
        return out, float(e @ y + self.pairs[y[k], y[k + 1]].sum() - total.sum())

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi's labels of a page; of equal sequences the one with less main text at its end."""
        e = self.emissions(x).tolist()
        (a, b), (c, d) = self.pairs.tolist()
        s0, s1, came = 0.0, e[0], []
        for score in e[1:]:
            came.append((s1 + c > s0 + a, s1 + d > s0 + b))
            s0, s1 = max(s0 + a, s1 + c), max(s0 + b, s1 + d) + score
        y = [s1 > s0]
        for step in reversed(came):
            y.append(step[y[-1]])
        return np.array(y[::-1], np.int8)


def main_texts(pages: list[str | None], field: Field) -> list[str]:
    """Main text of each page."""
    read = [blocks(html or "") for html in pages]
    x, sizes = features(read)
    out, at = [], 0
    for (found, _), n in zip(read, sizes.tolist(), strict=True):
        out.append("\n".join(b.text for b, y in zip(found, field.decode(x[at : at + n]), strict=True) if y) if n else "")
        at += n
    return out


def silver(found: list[Block]) -> np.ndarray:
    """Labels of a page by its own tags: within an article, and not within anything that speaks against it."""
    return np.fromiter((bool(b.bits & BIT["main"]) and not b.bits & BAD for b in found), np.int8, len(found))


#: Ways to write what isn't main text: how it begins and ends, and which of the given texts it takes (menu items, short lines, prose).
_AROUND = (
    ("<nav><ul>", "</ul></nav>", "items"), ('<div class="main-menu"><ul>', "</ul></div>", "items"), ('<header class="site-header">', "</header>", "lines"), ('<div id="masthead">', "</div>", "lines"),
    ("<footer>", "</footer>", "claims"), ('<div class="site-footer">', "</div>", "claims"), ("<aside>", "</aside>", "prose"), ('<div class="sidebar">', "</div>", "lines"), ('<div class="widget related-posts"><ul>', "</ul></div>", "items"),
    ('<form action="/search"><label>', "</label></form>", "lines"), ('<form class="signup">', "</form>", "prose"), ('<div class="cookie-notice">', "</div>", "prose"), ('<div role="dialog" class="popup">', "</div>", "lines"),
    ('<div class="ad">', "</div>", "prose"), ('<div class="sponsored">', "</div>", "lines"), ('<section id="comments"><h3>3 comments</h3>', "</section>", "prose"), ('<div class="comment-list">', "</div>", "prose"), ('<article class="comment">', "</article>", "prose"), ('<div class="social-share">', "</div>", "items"), ('<div hidden>', "</div>", "prose"),
)
#: And without anything that tells, which stands before or after an article only.
_BARE = (("<p>", "</p>", "claims"), ("<div>", "</div>", "claims"), ("<p>", "</p>", "items"), ("<ul>", "</ul>", "items"), ("<div>", "</div>", "items"))
_WITHIN = (("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="article-content">', "</div>"), ('<div id="story">', "</div>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", ""))
_PROSE = (
    "The council met on Monday to talk about the new bridge. After three hours it agreed to begin the work next spring.", "Nobody had expected the river to rise so quickly.", "Der Rat der Stadt hat am Montag über die neue Brücke gesprochen. Die Arbeiten sollen im Frühjahr beginnen.",
    "Viele Menschen kamen zu Fuß, weil die Busse nicht fuhren.", "Le conseil a discuté lundi du nouveau pont, et les travaux commenceront au printemps.", "Personne ne s'attendait à une telle crue.", "El ayuntamiento habló el lunes sobre el puente nuevo. Las obras empezarán en primavera.",
    "In 2019 the town had 4,300 inhabitants, about as many as ten years before.", "“We will see,” she said, and closed the door.", "Short paragraph.",
)
_ITEMS = ("Home", "News", "Sport", "Kontakt", "Impressum", "À propos", "Inicio", "Weather", "Login", "Archive")
_LINES = ("Subscribe to our newsletter", "Accept all cookies", "Search", "Follow us", "Anzeige", "The Daily Bridge", "Related stories")
_CLAIMS = ("© 2024 The Daily Bridge. All rights reserved.", "Copyright Example Ltd · Terms · Privacy", "Alle Rechte vorbehalten")


def layouts(main: list[str], other: list[str], how: random.Random) -> str:
    """A page of the given texts; its main text is marked with data-label."""

    def region(bare: bool = False) -> str:
        begin, end, kind = how.choice(_BARE if bare else _AROUND)
        if kind == "items":
            item = "<li><a href='/x'>{}</a></li>" if "<ul>" in begin else how.choice(("<a href='/x'>{}</a> ", "{} | "))
            return begin + "".join(item.format(escape(how.choice(_ITEMS))) for _ in range(how.randint(2, 7))) + end
        if kind == "prose":
            return begin + "".join(f"<p>{escape(how.choice(main + other + list(_PROSE)))}</p>" for _ in range(how.randint(1, 3))) + end
        return begin + "".join(f"<div>{escape(x)}</div>" for x in how.choices(_CLAIMS if kind == "claims" else [*_LINES, *other], k=how.randint(1, 2))) + end

    begin, end = how.choice(_WITHIN)
    heading = [f"<h1 data-label=1>{escape(main[0])}</h1>"] if how.random() < 0.8 else []
    body = heading + [f"<{t} data-label=1>{escape(x)}</{t}>" for x in main[1:] or main for t in [how.choice(("p", "p", "p", "div", "li", "blockquote", "h2"))]]
    for _ in range(how.choice((0, 0, 1, 2))):
        body.insert(how.randint(0, len(body)), region())
    before, after = ("".join(region(how.random() < 0.3) for _ in range(how.randint(0, 3))) for _ in range(2))
    return f"<html><head><title>{escape(main[0][:60])}</title></head><body>{before}{begin}{''.join(body)}{end}{after}</body></html>"


def labelled(html: str, how: random.Random, again: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training pages from a page: itself, if it marks an article, and its texts laid out anew."""
    found, title = blocks(html)
    y = silver(found)
    if not y.any() or len(found) > TRAIN_BLOCKS:
        return []
    out = [(features([(found, title)])[0], y)]
    main, other = [b.text for b, k in zip(found, y, strict=True) if k], [b.text for b, k in zip(found, y, strict=True) if not k]
    return out + [laid_out(main, other, how) for _ in range(again)]


def laid_out(main: list[str], other: list[str], how: random.Random) -> tuple[np.ndarray, np.ndarray]:
    found, title = blocks(layouts(main, other, how))
    return features([(found, title)])[0], np.fromiter((b.bits & BIT["label"] > 0 for b in found), np.int8, len(found))


def _packed(x: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes]:
    return np.packbits(x, axis=1).tobytes(), y.astype(np.uint8).tobytes()


def _unpacked(xs: list[bytes], ys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(b"".join(ys), np.uint8).astype(np.int64)
    x = np.unpackbits(np.frombuffer(b"".join(xs), np.uint8).reshape(len(y), -1), axis=1)[:, :SIZE]
    return x.astype(np.float32), y, np.fromiter((len(v) for v in ys if v), np.int64)


def training_pages(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """x, y: bits of the features and labels of about ``most`` pages and their other layouts, and of pages of our own."""
    n = pages.count()
    some = pages.select("html").sample(False, min(1.0, most / max(n, 1)), SEED)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_packed(*z) for html in batch["html"].to_pylist() if html for z in labelled(html, random.Random(f"{SEED} {len(html)} {html[:500]}"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["x", "y"])

    how = random.Random(SEED)
    own = [_packed(*laid_out(how.sample(_PROSE, how.randint(2, 8)), [], how)) for _ in range(200)]
    spark = pages.sparkSession
    return written(some.mapInArrow(made, "x binary, y binary").unionByName(spark.createDataFrame(own, "x binary, y binary")), "labelled")


def fitted(training: DataFrame, steps: int = STEPS) -> Field:
    """The field of the greatest likelihood of the labels, less a ridge: steps of a size of its own for each weight, which grows while the sign of its gradient stays and shrinks where it turns."""
    theta, size, sign = np.zeros(SIZE + 4), np.full(SIZE + 4, 0.1), np.zeros(SIZE + 4)
    blocks_in = training.agg(F.sum(F.octet_length("y"))).first()[0] or 1
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], field: Field = Field(theta)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SIZE + 4)
            for batch in batches:
                x, y, sizes = _unpacked(batch["x"].to_pylist(), batch["y"].to_pylist())
                if len(y):
                    total += field.gradient(x, y, sizes)[0]
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["g"])

        gathered = [r.g for r in training.mapInArrow(sums, "g array<double>").collect()]  # a row of fixed size for each partition of a bounded table
        g = np.sum(gathered, axis=0) / blocks_in - RIDGE * theta
        now = np.sign(g)
        size = np.clip(np.where(now * sign > 0, size * 1.2, np.where(now * sign < 0, size * 0.5, size)), 1e-4, 1.0)
        now[now * sign < 0] = 0
        theta, sign = theta + now * size, now
    return Field(theta)


def extractor(field: Field) -> Callable[[Column | str], Column]:
    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array(main_texts(html.to_pylist(), field), pa.string())

    return text


def extracted(pages: DataFrame, field: Field, html: str = "html") -> DataFrame:
    """``pages`` with their main text in a column ``text``, which replaces one of that name."""
    bound_batches(pages.sparkSession)
    kept = [c for c, name in zip(columns(pages), pages.columns, strict=True) if name != "text"]
    return pages.select(*kept, extractor(field)(html).alias("text"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``pages``. Null and empty pages have an empty text; repeated rows get the same."""
    bound_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    field = fitted(training_pages(pages))
    return extracted(pages, field).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
