"""Vector codes, the conversation trie and main text against brute force, on odd tables and small parts."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidtext.llm import _dom, _shared, codes, extract, prefixes, queries


# --- op11


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Full scans, one part after the other."""
    kept = [(i, label, [math.floor(4096 * c) for c in v]) for i, label, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for *_, v in order[:entries]] for p in range(parts)]
    assign = lambda: [[min(range(len(books[p])), key=lambda k: (far(cut(v, p), books[p][k]), k)) for p in range(parts)] for *_, v in kept]
    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (*_, v), c in zip(kept, now, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x[j] for x in own) // len(own) for j in range(width)]
    out = []
    for (i, label, v), c in zip(kept, assign(), strict=True):
        out.append((i, label, "".join(f"{k:02x}" for k in c), sum(far(cut(v, p), books[p][c[p]]) for p in range(parts))))
    total = defaultdict(int)
    for _, label, _, e in out:
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return sorted((repr((i, c, e, total[label], digest)) for i, label, c, e in out))


def vectors():
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    rows = [(k, k % 4 if k % 3 else None, [x + rng.gauss(0, 0.3) for x in centre[k % 5]]) for k in range(90)]
    rows += [(3, 1, rows[3][2]), (3, 1, rows[3][2]), (None, 2, rows[9][2]), (101, 1, None), (102, 1, [1.0] * 15 + [None]), (103, 1, [float("nan")] * 16), (104, 2, [float("inf")] + [0.0] * 15)]
    rows += [(105, 2, [0.5, -0.5, 0.25]), (106, None, []), (107, 0, [0.0] * 16), (108, 0, [0.0] * 16), (109, 3, [-1000.0] * 16)]
    return rows


@pytest.mark.parametrize("keep", [200, 7, 0])
def test_op11(spark, tmp_path, keep):
    rows = vectors()[:keep]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"v": F.lit("x"), "kind": F.lit(1), "a.b": F.lit(2)})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op11_codes"](spark, str(tmp_path)).collect()
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == lloyd(rows)


def test_bounds_hold_and_save_scans():
    """Codes and bounds of moved codebooks are those of a full scan; most parts aren't scanned."""
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 4000, (16, 2, 4))
    x = (centre[rng.integers(0, 16, 3000)] + rng.normal(0, 700, (3000, 2, 4))).astype(np.int64)
    books = x[:16].transpose(1, 0, 2).copy()
    books[:, 5] = books[:, 2]  # two entries at one place
    n = len(x)
    state = np.zeros((n, 2), np.uint8), np.zeros((n, 2), "<f4"), np.zeros((n, 2), "<f4")
    before, scanned = None, []
    for _ in range(8):
        scanned.append(codes.Step(before, books)(x, *state))
        far = np.sqrt(((x[:, :, None, :] - books[None]) ** 2).sum(-1).astype(float))
        for p in range(2):
            d = far[:, p]
            assert (state[0][:, p] == ((x[:, p, None, :] - books[p][None]) ** 2).sum(-1).argmin(1)).all()
            own = d[np.arange(n), state[0][:, p]]
            d[np.arange(n), state[0][:, p]] = np.inf
            assert (state[1][:, p] >= own).all() and (state[2][:, p] <= d.min(1)).all()
        before, books = books, books.copy()
        for p in range(2):
            for k in np.unique(state[0][:, p]):
                books[p, k] = np.floor_divide(x[state[0][:, p] == k, p].sum(0), (state[0][:, p] == k).sum())
    assert scanned[0] == 2 * n and scanned[-1] < n / 2


# --- op12


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = lambda n: [x for x in members if x[: len(n)] == n]
    children = lambda n: [x for x in members if len(x) == len(n) + 1 and x[:-1] == n]
    out = []
    for n, cs in members.items():
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below(n) if x)
        ends = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(n))))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(children(n)), sum(not children(x) for x in below(n)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def talks(rng, convs, turns, words):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(convs) for t in range(rng.randrange(1, turns))]


@pytest.fixture(scope="module")
def odd_talks():
    rng = random.Random(4)
    rows = talks(rng, 40, 14, ["", "a", "ä🙂", None]) + talks(rng, 30, 3, ["hi"])
    rows += [(100, t, "user", f"word {t % 3}") for t in range(60)] + [(105, t, "user", "same") for t in range(40)] + [(106, t, "user", "same") for t in range(40)] + [(111, 0, "user", "x" * 40_000)]
    rows += [(102, None, "user", "first"), (102, None, None, None), (102, 1, "b", "tie"), (102, 1, "a", "tie"), (102, 1, "a", "tie"), (None, 1, "user", "nobody"), (-3, 0, "user", "a"), (-5, 0, "user", "a"), (-7, 3, None, "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("chunk", "sent", "piece"), [(4096, _shared.SENT_VALUES, 1024), (3, _shared.SENT_VALUES, 1), (1, 0, 2), (5, 0, 2)])
def test_op12(spark, tmp_path, monkeypatch, odd_talks, chunk, sent, piece):
    monkeypatch.setattr(_shared, "SENT_VALUES", sent)
    df = spark.createDataFrame(odd_talks, "conv_id long, turn long, role string, text string").withColumns({"fam": F.lit(1), "k1": F.lit("x"), "n": F.lit(None).cast("int")})
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    small = _small(chunk, piece)
    got = small(spark, str(tmp_path)) if chunk != 4096 else queries.queries()["op12_prefixes"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == trie(odd_talks)


def _small(chunk, piece):
    """The query with chunks, pieces and partial tries of a few rows, in the workers too."""

    def run(spark, sf_dir):
        chunked, listed, gathered = prefixes._chunked, prefixes._listed, prefixes._gathered

        def with_small(f):
            def g(batches, *more):
                prefixes.CHUNK, prefixes.PIECE, prefixes.NODES = chunk, piece, 8
                yield from f(batches, *more)

            return g

        prefixes._chunked, prefixes._listed, prefixes._gathered = with_small(chunked), with_small(listed), with_small(gathered)
        try:
            return queries.queries()["op12_prefixes"](spark, sf_dir).collect()
        finally:
            prefixes._chunked, prefixes._listed, prefixes._gathered = chunked, listed, gathered

    return run


def test_op12_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.queries()["op12_prefixes"](spark, str(tmp_path)).count() == 0


# --- op13


def texts(html):
    return [b.text for b in _dom.blocks(html)[0]]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a<p>b<br>c<div>d</div>e", ["a", "b c", "d", "e"]),
        ("<p>x &lt;b&gt; &amp;amp; &#228;&nbsp; y</p>", ["x <b> &amp; ä y"]),
        ("a<script>var t='</p>';</script>b<style>p{}</style><!-- <p>no</p> -->c", ["abc"]),
        ("<script>never closed <p>x", []),
        ("<div><!-- never closed <p>x", []),
        ("<p title='a>b' class=\"c>d\">in</p>", ["in"]),
        ('<p title="never closed>in</p><p>more</p>', ["in", "more"]),
        ("1 < 2 and <3 </> <!x> <?y?> </p>end", ["1 < 2 and <3", "end"]),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", ["one", "two", "in", "three"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<b><p>bold</b> still</p>after", ["bold still", "after"]),
        ("<head><title>T</title></head><body>x<select><option>1</select><textarea>t</textarea></body>", ["x"]),
        ("</div></b></p>z", ["z"]),
        ("<DIV>Big</DIV><P>Small", ["Big", "Small"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


def test_blocks_know_their_ancestors():
    found, title = _dom.blocks("<title> My  title </title><article><p>in <a href=x>link</a></p><div class='cookieNotice'>bad</div></article><p>out</p>")
    b = _dom.BIT
    assert title == "My title" and [(x.text, x.bits, x.link) for x in found] == [("in link", b["main"], 4), ("bad", b["main"] | b["notice"], 0), ("out", 0, 0)]


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "x", "<a '" * 20_000, "</p>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000, "<" * 100_000, "<!--" * 30_000, "<p>" * 50_000 + "end"])
def test_bad_pages_take_no_longer(html):
    import time

    began = time.time()
    _dom.blocks(html)
    assert time.time() - began < 5


def test_sums_are_those_of_all_label_sequences():
    rng = np.random.default_rng(3)
    field = extract.Field(rng.normal(0, 0.5, extract.SIZE + 4))
    sizes = [1, 4, 2, 4]
    x = rng.integers(0, 2, (sum(sizes), extract.SIZE)).astype(np.float64)
    y = rng.integers(0, 2, sum(sizes))

    def likelihood(theta):
        f, at, total = extract.Field(theta), 0, 0.0
        for n in sizes:
            e, own = f.emissions(x[at : at + n]), y[at : at + n]
            score = lambda ls, e=e, f=f: sum(e[i] * k for i, k in enumerate(ls)) + sum(f.pairs[a, b] for a, b in zip(ls, ls[1:], strict=False))
            every = [[m >> i & 1 for i in range(n)] for m in range(1 << n)]
            total += score(own.tolist()) - math.log(sum(math.exp(score(s)) for s in every))
            best = max(every, key=score)
            assert score(field.decode(x[at : at + n]).tolist()) <= score(best) + 1e-9
            if theta is field.theta:
                assert field.decode(x[at : at + n]).tolist() == best
            at += n
        return total

    g, value = field.gradient(x, y, np.array(sizes))
    assert value == pytest.approx(likelihood(field.theta))
    for k in [0, 5, 30, *range(extract.SIZE, extract.SIZE + 4)]:
        step = np.zeros(extract.SIZE + 4)
        step[k] = 1e-5
        assert g[k] == pytest.approx((likelihood(field.theta + step) - likelihood(field.theta - step)) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def field(spark):
    return extract.fitted(extract.training_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 0")))


def test_held_out_pages(spark, field):
    """Pages that weren't trained on: the article and nothing else. Other layouts of their texts: nearly all blocks."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 1").select("html").collect()
    how, wrong, total = random.Random(9), 0, 0
    for (html,), got in zip(rows, extract.main_texts([r.html for r in rows], field), strict=True):
        found, _ = _dom.blocks(html)
        main = [b.text for b in found if b.bits & _dom.BIT["main"]]
        assert got == "\n".join(main)
        x, y = extract.laid_out(main, [b.text for b in found if not b.bits & _dom.BIT["main"]], how)
        wrong, total = wrong + int((field.decode(x) != y).sum()), total + len(y)
    assert wrong < 0.01 * total


PAGE = """<html><head><title>My page</title></head><body><div class="cookie-banner"><p>We use cookies to make this site better. Please accept them.</p></div><header><a href=/>Logo</a></header>
<div class="menu"><a href=a>One</a> <a href=b>Two</a></div>{}<h1>My page</h1><p>First paragraph of the text, with <a href=x>a link</a> in it &amp; more.</p><div class="ad">Buy our things now. They are cheap.</div>
<p>Second one.<br>With a break.</p><blockquote>They said so.</blockquote><section class="comments"><div class="comment"><p>I liked this text very much. It was really a good one to read.</p></div></section>{}
<aside><p>Other stories you may like. Read them all.</p></aside><form><label>Search</label><input></form><div class="site-footer">© 2020 Me</div></body></html>"""


@pytest.mark.parametrize(("begin", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ('<div id="content">', "</div>"), ("<article>", "")])
def test_other_layouts(field, begin, end):
    assert extract.main_texts([PAGE.format(begin, end)], field) == ["My page\nFirst paragraph of the text, with a link in it & more.\nSecond one. With a break.\nThey said so."]


def test_op13(spark, tmp_path):
    html = "<nav><a href=/>Home</a></nav><article><p>One sentence here, and it is long enough. Another one follows it.</p></article>"
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (None, "u", ""), (3, "u", "<p> </p>"), (4, "u", "<article>" + "<p>Many words stand here. </p>" * 20_000 + "</article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1), "a.b": F.lit(2)}).write.parquet(f"{tmp_path}/pages.parquet")
    one, many = "One sentence here, and it is long enough. Another one follows it.", "\n".join(["Many words stand here."] * 20_000)
    got = queries.queries()["op13_main_text"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, u, t, len(t))) for (i, u, _), t in zip(rows, [one, one, "", "", "", many], strict=True))


def test_op13_without_rows_or_articles(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/a/pages.parquet")
    assert queries.queries()["op13_main_text"](spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "u", "<div class=menu><a href=x>Home</a></div><div class=content><p>No article is marked here. But there is a text.</p></div>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert [r.text for r in queries.queries()["op13_main_text"](spark, f"{tmp_path}/b").collect()] == ["No article is marked here. But there is a text."]
