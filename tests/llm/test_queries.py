"""Every opN query on odd tables against brute force; the SQL of this subpackage; both sides of joins that depend on size."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import FOLD, PLAIN, brute_classes, brute_hits, brute_spans, prose, water

from lucidtext.llm import _shared, decontaminate, langid, lines, neardup, pii, quality, queries, sharding, tokens

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts(rng):
    base = prose(rng, 120).split()
    near = list(base)
    near[60] = "changed"
    texts = [None, "", " \n\t", "one", "one two", "A, b; ÄÖ straße 123", "x" * 30_000, "7" * 9_000, " ".join(base), " ".join(base), " ".join(near)]
    texts += ["Mail a.b@c.de or 10.0.0.255, card 4111 1111 1111 1111, call +49 (30) 1234567.", "中文没有空格" * 500, "🙂 é\x00\x0b" * 50, "the end.\n\nthe end.\nthe end.\n" * 20]
    texts += [prose(rng, rng.randrange(30, 160)) + f"\nPage {k} of 99 in our public archive.\n" + prose(rng, 9) for k in range(12)]
    return texts


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, null and repeated ids, columns with clashing names and dots."""
    rng = random.Random(11)
    texts = odd_texts(rng)
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", "B", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, None, None, None, None), (None, "null id " * 40, "en", "a", 1), (None, "null id " * 40, "en", "a", 1), (None, "another text without an id", "de", None, 2), (5, "other text of a known id", "de", "a", 3)]
    at = str(tmp_path_factory.mktemp("odd"))
    extra = {"h": F.lit(1), "node": F.lit("x"), "_row": F.lit(2), "_id": F.lit(None).cast("int"), "copies": F.lit(9), "a.b": F.lit("dot"), "shard": F.lit(0), "size": F.lit(3)}
    spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join(texts[20].split()[2:18])), (2, "one two"), (3, None), (4, ""), (None, "zzz"), (2, "one two"), (5, texts[8])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    html = "<html lang=de><body>der und die {}</body></html>"
    pages = [(1, "https://www.example.com/en/x", html), (2, None, None), (3, "no host", ""), (None, "https://A.net/es/y?q#f", "<p>" + "x " * 50_000), (1, "https://www.example.com/en/x", html), (4, "http://b.co.uk/" + "p" * 20_000, html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("a.b", F.lit(1)).write.parquet(f"{at}/pages.parquet")
    return at, rows, items, pages


@pytest.fixture(scope="module")
def nothing(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{odd[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    for name in ("embeddings", "conversations"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


def run(spark, odd, name):
    return queries.queries()[name](spark, odd[0]).collect()


def key(x):
    return tuple((v is not None, v) if not isinstance(v, bool) else (True, int(v)) for v in x)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(x for x in queries.queries() if x.startswith("op")))
def test_empty_tables(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).count() == 0


def test_op1(spark, odd):
    _, rows, items, _ = odd
    brute = brute_hits([r[1] for r in rows], [("" if i is None else i, t) for i, t in items])
    want = [(r[0], n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0 and 20 * hit >= n) for r, (n, hit, own) in zip(rows, brute, strict=True)]
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, odd, "op1_decontaminate")], want)


def test_op2(spark, odd):
    _, rows, _, _ = odd
    size = [len(PLAIN.findall(r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    target, taken = water(total), Counter()
    got = run(spark, odd, "op2_mix")
    same([(r.doc_id, r.size) for r in got], [(r[0], n) for r, n in zip(rows, size, strict=True)])
    of = {(r[0], n): r[3] for r, n in zip(rows, size, strict=True)}
    for r in got:
        source = of[r.doc_id, r.size]
        assert r.taken <= 3 * r.size and r.source_size == total[source] and r.target == pytest.approx(target[source])
        taken[source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(n for r, n in zip(rows, size, strict=True) if r[3] == s)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, odd, "op2_mix")))


def jumped(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def spread(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


@pytest.mark.parametrize("chunk", [sharding.CHUNK_ROWS, 1])
def test_op3(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(sharding.shard, "__defaults__", (chunk,))
    _, rows, _, _ = odd
    want = []
    for r in rows:
        h = spread(((r[0] + 0x9E3779B97F4A7C15) if r[0] is not None else 2 * 0x9E3779B97F4A7C15) % (1 << 64))
        text = (r[1] or "").encode()
        want.append((r[0], len(text) + 8, zlib.crc32(text), "key", jumped(h, 24), jumped(h, 25)))
    got = run(spark, odd, "op3_shard")
    same([(r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got], want)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def fused_by_hand(pages, docs):
    """Sums in dictionaries, one page after the other."""
    langs = sorted({d[2] for d in docs if d[2] is not None})
    grams = lambda t: Counter(langid._trigrams(pa.array([t], pa.string()))[1].tolist())
    counts = {x: Counter() for x in langs}
    for d in docs:
        if d[2] is not None:
            counts[d[2]].update(grams(d[1]))
    cells = 1 << langid.HASH_BITS
    whole = {x: sum(c.values()) + langid.ALPHA * cells for x, c in counts.items()}
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    seen = []
    for page_id, url, html in pages:
        own = grams(langid.visible(html))
        scores = np.array([sum(n * langid.DAMP * np.log((counts[x][g] + langid.ALPHA) / whole[x]) for g, n in own.items()) for x in langs])
        m = re.match(r"(?s).*?://([^/?#]*)", url or "")
        host = (m[1] if m else "").translate(FOLD)
        labels = host.split(".")
        three = len(labels) >= 3 and len(labels[-1]) == 2 and labels[-2] in ("co", "com", "org", "net", "gov", "edu", "ac")
        domain = ".".join(labels[-3:] if three else labels[-2:]) if len(labels) >= 2 else host
        said = langid._DECLARED.search(html or "")
        post = soft(scores) if own else np.zeros(len(langs))
        seen.append((page_id, {"host": host, "domain": domain, "declared": said[1].lower() if said else "", "suffix": labels[-1]}, scores, post))
    world, out = sum(s[3] for s in seen), []
    for page_id, keys, scores, post in seen:
        about = {k: sum(s[3] for s in seen if s[1][k] == v) - post for k, v in keys.items()}
        smooth = lambda c, wider: (c + langid.KAPPA * wider) / (c.sum() + langid.KAPPA)
        prior = smooth(about["host"], smooth(about["domain"], (world + 1) / (world.sum() + len(langs))))
        others = world - post + 1
        p = soft(scores + np.log(prior) + np.log((about["declared"] + 0.5) / others) + np.log((about["suffix"] + 0.5) / others))
        out.append((page_id, langs[int(p.argmax())], round(float(p.max()), 3), keys["declared"], keys["suffix"]))
    return out


@pytest.mark.parametrize("sent", [_shared.SENT_VALUES, 0])
def test_op4(spark, odd, monkeypatch, sent):
    monkeypatch.setattr(_shared, "SENT_VALUES", sent)
    _, rows, _, pages = odd
    same([(r.page_id, r.lang, round(r.probability, 3), r.declared, r.suffix) for r in run(spark, odd, "op4_language")], fused_by_hand(pages, rows))


def test_more_languages_than_one_count_holds(spark, monkeypatch):
    monkeypatch.setattr(langid, "DENSE_CELLS", 1)
    rng = random.Random(3)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(501)}
    docs = spark.createDataFrame([(" ".join(w * 4), x) for x, w in words.items()], "text string, lang string")
    asked = ["l000", "l250", "l500"]
    pages = spark.createDataFrame([(i, f"https://h{i}.org/", f"<p>{' '.join(words[x] * 4)}</p>") for i, x in enumerate(asked)], "page_id long, url string, html string")
    assert [r.text_lang for r in langid.identified(pages, docs).orderBy("page_id").collect()] == asked


def test_op5(spark, odd):
    from tokenizers import Tokenizer

    _, rows, _, _ = odd
    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = sorted(run(spark, odd, "op5_tokens"), key=lambda r: r.start)
    want = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids)))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_op6(spark, odd):
    _, _, _, pages = odd
    want = []
    for page_id, url, _ in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        want.append((page_id, host, path, best[1], best[2]))
    same([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in run(spark, odd, "op6_urls")], want)


@pytest.mark.parametrize("sent", [_shared.SENT_VALUES, 0])
def test_op7(spark, odd, monkeypatch, sent):
    monkeypatch.setattr(_shared, "SENT_VALUES", sent)
    _, rows, _, _ = odd
    sets, classes = brute_classes(rows, 3, 90)
    least = defaultdict(list)
    for r, s, c in zip(rows, sets, classes, strict=True):
        if s:
            least[c].append(r[0])
    smallest = {c: min((x for x in own if x is not None), default=None) for c, own in least.items()}
    want = [(r[0], len(s), smallest[c] if s else r[0]) for r, s, c in zip(rows, sets, classes, strict=True)]
    same([(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, odd, "op7_neardup")], want)


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_colliding_keys_lose_no_link(spark, bits):
    """Join keys cut down to a few bits: bands and strangers fall into the same buckets."""
    rng = random.Random(bits)
    texts = []
    for n in (8, 12, 30, 31, 60, 61, 120):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for k in range(4):
            own = list(base)
            for _ in range(k * n // 60):
                own[rng.randrange(n)] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = defaultdict(set)
    for r in _classes_with((1 << bits) - 1, docs, 3, 70):
        got[r["class"]].add(r.doc_id)
    _, classes = brute_classes(rows, 3, 70)
    want = defaultdict(set)
    for (i, _), c in zip(rows, classes, strict=True):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def _classes_with(mask, docs, k, percent):
    """neardup.classes with join keys of a few bits."""
    original = neardup._sketched
    neardup._sketched = lambda *given: original(*given).withColumn("keys", F.transform("keys", lambda x: x.bitwiseAND(F.lit(mask).cast("long"))))
    try:
        return neardup.classes(docs, k, percent).collect()
    finally:
        neardup._sketched = original


def lines_by_hand(rows):
    """The tree in dictionaries of sets of texts."""
    texts = {r[1] for r in rows if r[1]}
    own = {t: [line.split() for line in t.encode().split(b"\n")] for t in texts}
    mask = lambda w: b"<*>" if re.search(rb"[0-9]", w) else w
    leaf = lambda ws: (len(ws), tuple(map(mask, ws[: lines.DEPTH])))
    at, whole = defaultdict(set), defaultdict(set)
    short = lambda ws: len(ws) < lines.MIN_CONSTANT and re.search(rb"[A-Za-z\x80-\xFF]", b" ".join(ws))
    for t, ls in own.items():
        for ws in ls:
            if short(ws):
                whole[tuple(ws)].add(t)
            if len(ws) >= lines.MIN_CONSTANT:
                whole[tuple(ws)].add(t)
                for k, w in enumerate(ws):
                    at[leaf(ws), k, mask(w)].add(t)

    def template(ws):
        kept = tuple(w if w != b"<*>" and len(at[leaf(ws), k, w]) >= lines.MIN_TEXTS else None for k, w in enumerate(map(mask, ws)))
        n = sum(w is not None for w in kept)
        return kept if n >= lines.MIN_CONSTANT and n >= lines.MIN_SHARE * len(kept) else None

    having = defaultdict(set)
    for t, ls in own.items():
        for ws in ls:
            if len(ws) >= lines.MIN_CONSTANT and template(ws):
                having[leaf(ws), template(ws)].add(t)
    gone = lambda ws: short(ws) and len(whole[tuple(ws)]) >= lines.MIN_SHORT or len(ws) >= lines.MIN_CONSTANT and (len(whole[tuple(ws)]) >= lines.MIN_SAME or (template(ws) is not None and len(having[leaf(ws), template(ws)]) >= lines.MIN_TEXTS))
    out = []
    for r in rows:
        cut = (r[1] or "").split("\n")
        drop = [gone(line.encode().split()) for line in cut] if r[1] else [False]
        kept = "\n".join(line for line, d in zip(cut, drop, strict=True) if not d)
        out.append((r[0], len(cut) if r[1] is not None else 0, sum(drop), len(kept), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("sent", [_shared.SENT_VALUES, 0])
def test_op8(spark, odd, monkeypatch, sent):
    monkeypatch.setattr(_shared, "SENT_VALUES", sent)
    _, rows, _, _ = odd
    want = lines_by_hand(rows)
    assert sum(w[2] for w in want) >= 12
    same([(r.doc_id, r.n_lines, r.n_dropped, r.kept_chars, r.kept_sha256) for r in run(spark, odd, "op8_lines")], want)


def test_template_tree_by_hand(spark, tmp_path):
    """Many lines of few words: leaves, tokens and templates at the edge of their limits."""
    rng = random.Random(21)
    heads = ["we are glad to say", "see page 3 of the", "all of us here now"]
    line = lambda: f"{rng.choice(heads)} {rng.choice(['red', 'blue', str(rng.randrange(9))])} {rng.choice('abcdefgh')} {rng.choice(['end', 'stop'])}"
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 5))), None, None, 0) for i in range(60)] + [(99, "x" * 100_000 + " a b c d e", None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op8_lines"](spark, str(tmp_path)).collect()
    same([(r.doc_id, r.n_lines, r.n_dropped, r.kept_chars, r.kept_sha256) for r in got], lines_by_hand(rows))


def test_short_lines_recur_from_a_higher_count(spark, tmp_path):
    rng = random.Random(5)
    often, seldom, signs = "Read more", "All rights reserved", "} 12"
    rows = [(i, "\n".join([prose(rng, 12), often, signs] + [seldom] * (i < lines.MIN_SHORT - 1) + [" \t"]), None, None, 0) for i in range(lines.MIN_SHORT)]
    rows += [(100, rows[0][1], None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op8_lines"](spark, str(tmp_path)).collect()
    want = lines_by_hand(rows)
    assert [w[2] for w in want] == [1] * len(rows)
    same([(r.doc_id, r.n_lines, r.n_dropped, r.kept_chars, r.kept_sha256) for r in got], want)


def test_op9(spark, odd):
    _, rows, _, _ = odd
    want = []
    for r in rows:
        base = brute_spans(r[1] or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((r[0], *(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k, _ in pii.spans(r[1]))))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in run(spark, odd, "op9_pii")], want)


def test_context_is_whole_words():
    kinds = lambda t: [s[2] for s in pii.spans(t)]
    assert not kinds("The syntax of 86095742719") and kinds("The tax number 86095742719") == ["tax"] and kinds("Steuernummer 86095742719") == ["tax"]
    assert not kinds("syn" + "tax" * 1 + " " * 36 + "86095742719") and not kinds("a" * 3 + "steuer" + " " * 37 + "86095742719")
    score = lambda t: pii.spans(t)[0][3]
    assert score("recipe 1.2.3.4") == score("x 1.2.3.4") < score("ip 1.2.3.4")


def test_op10(spark, odd):
    import zstandard

    _, rows, _, _ = odd
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    inside = lambda x: next(lo <= len(x) / len(press.compress(x)) <= hi for top, lo, hi in quality.BANDS if top is None or len(x) <= top)
    want = []
    for r in rows:
        t = r[1] or ""
        w = PLAIN.findall(t)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        seen = [x for x in t.split("\n") if PLAIN.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        raw = t.encode()
        chunks = [raw[k : k + quality.CHUNK] for k in range(0, len(raw), quality.CHUNK)]
        kept = not failed and inside(raw) and sum(not inside(c) for c in chunks) <= quality.MAX_BAD_SHARE * len(chunks)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(seen) - len(set(seen)), len(hit), failed, kept))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in run(spark, odd, "op10_quality")], want)
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_phrases_are_distinct_windows():
    rng = random.Random(2)
    items = [(f"i{k}", prose(rng, rng.randrange(0, 40), ["a", "b", "c", "d"])) for k in range(30)] + [("i3", "a b"), ("z", None)]
    p = decontaminate.Phrases(items, 5)
    words = [x.decode() for x in p.words.to_pylist()]
    got = {}
    for k in range(len(p.start)):
        phrase = tuple(words[x] for x in p.stream[p.start[k] : p.start[k] + p.size[k]])
        assert phrase not in got
        _, own = p.owners(np.array([k]))
        got[phrase] = {p.names[x] for x in own}
    want = defaultdict(set)
    for item, t in items:
        w = (t or "").split()
        for i in range(max(len(w) - 4, min(len(w), 1))):
            want[tuple(w[i : i + 5])].add(item)
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())
