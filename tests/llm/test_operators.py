"""Corpus operators against brute force, round trips and edge inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lucidtext.llm import _words, components, decontaminate, langid, lines, mixing, neardup, pii, quality, sharding, tokens, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Edge texts, copies, near copies of a hub, passages, and prose."""
    rng = random.Random(7)
    base = prose(rng, 300).split()
    texts = [None, "", "   \n", "one", "one two", "A, b; ÄÖ straße 123", "x" * 50_000, "the end.\n\nthe end.\nthe end."]
    texts += [" ".join(base)] * 5
    for k in range(30):
        near = list(base)
        for _ in range(k % 6 + 1):
            near[rng.randrange(len(near))] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(near))
    texts += [prose(rng, rng.randrange(20, 200)) + "\n" + "Shared boilerplate line of page 7 number 12 here.\n" * (k % 3 == 0) for k in range(60)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[10], (None, "null id " * 30, None, None, None), (None, "null id " * 30, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_equal_regular_expressions(corpus):
    texts = [r[1] for r in corpus] + ["İ é\x85z\x0bq", "\n", "a\tb", "\x00a\x7fb"]
    for table, pattern, lower in ((_words.ALNUM, WORD, True), (_words.NOT_SPACE, PLAIN, False)):
        w = _words.words(pa.array(texts, pa.string()), table, lower)
        got = [x.decode() for x in w.values().to_pylist()]
        want = [pattern.findall((t or "").translate(FOLD) if lower else t or "") for t in texts]
        assert got == [x for ws in want for x in ws]
        assert w.counts().tolist() == list(map(len, want))


# --- decontamination


def brute_hits(texts, items, window=13):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall((t or "").translate(FOLD))
        for i in range(max(len(w) - window + 1, 1 if w else 0)):
            windows[tuple(w[i : i + window])].add(str(item))
    out = []
    for t in texts:
        w, hit, found = WORD.findall((t or "").translate(FOLD)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination_by_brute_force(spark, docs, corpus, block_bytes):
    rng = random.Random(1)
    items = [(i, " ".join(corpus[40 + i][1].split()[3 : 3 + rng.randrange(13, 19)])) for i in range(8)] + [(90, "one two"), (91, None), (92, ""), (93, "zzz yyy"), (94, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.search(decontaminate.build_index(docs), bench, block_bytes=block_bytes).collect()
    got = sorted((r.n_words, r.n_hit, r["items"], r.doc_id is None, r.doc_id or 0) for r in found)
    want = sorted((*b, r[0] is None, r[0] or 0) for r, b in zip(corpus, brute_hits([r[1] for r in corpus], items), strict=True))
    assert got == want
    assert sum(r.n_hit > 0 for r in found) > 8


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta x x x x gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = decontaminate.search(decontaminate.build_index(docs), bench, slop=1).where("n_hit > 0").collect()
    assert [r.doc_id for r in near] == [1]
    assert decontaminate.search(decontaminate.build_index(docs), bench).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("slop", [0, 1, 2, 5, 100])
def test_proximity_keeps_order(spark, slop):
    """A match's words ascend, none serves twice, and at most ``slop`` others lie between them."""
    rng = random.Random(slop)
    texts = ["b a", "a", "a a", "a b", "a x b"] + [" ".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    phrases = ["a b", "a a", "b a c", "a b a b", "d", "c c c"]
    want = []
    for d, t in enumerate(texts):
        w, hit, items = t.split(), set(), set()
        for p in phrases:
            own = p.split()
            for i in range(len(w)):
                last = i
                for j, x in enumerate(own):
                    last = next((k for k in range(last + (j > 0), len(w)) if w[k] == x), None) if j else (i if w[i] == x else None)
                    if last is None or last - i - j > slop:
                        break
                else:
                    hit |= set(range(i, last + 1))
                    items.add(p)
        if hit:
            want.append((d, len(hit), sorted(items)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(p, p) for p in phrases], "item_id string, text string")
    got = decontaminate.search(decontaminate.build_index(docs), bench, slop=slop).where("n_hit > 0").collect()
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in got) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN DE89370400440532013000 EUR", [(5, 27)]),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", [(5, 32)]),
        ("gb82 west 1234 5698 7654 32.", [(0, 27)]),
        ("NL91ABNA0417164300DE89370400440532013000", []),
        ("NL91ABNA0417164300 DE89370400440532013000", [(0, 18), (19, 41)]),
        ("DE89370400440532013001", []),
        ("DE893704004405320130001", []),
        ("XX89370400440532013000", []),
        ("xDE89370400440532013000", []),
    ],
)
def test_ibans(text, want):
    assert [(a, b) for a, b, kind, _ in pii.spans(text) if kind == "iban"] == want


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(decontaminate.build_index(docs), bench).where("n_hit > 0").count() == 0
    assert decontaminate.search(decontaminate.build_index(none), bench).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, passage), (None, "clean one"), (None, "clean two"), (None, None), (5, passage), (5, "clean"), (5, "clean"), (6, passage), (7, "clean")]
    got = decontaminate.stage_decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[1] != passage)


# --- mixing


def sizes_of(spark, corpus):
    return spark.createDataFrame([(r[0], r[3], len(PLAIN.findall(r[1] or ""))) for r in corpus], "doc_id long, source string, size long")


def test_word_count(spark, corpus):
    got = spark.createDataFrame([(r[1],) for r in corpus], "t string").select(mixing.word_count("t").alias("n")).collect()
    assert [r.n for r in got] == [len(PLAIN.findall(r[1] or "")) for r in corpus]


def water(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w, total, full = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest)
        new = {s for s in rest if level * w[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= new


@pytest.mark.parametrize("skew", [False, True])
def test_mix(spark, corpus, skew):
    rows = sizes_of(spark, corpus) if not skew else spark.createDataFrame([(i, "a", 100 + i % 50) for i in range(900)] + [(i, "b", 20) for i in range(900, 930)] + [(i, "c", 7) for i in range(930, 935)], "doc_id long, source string, size long")
    given = rows.collect()
    total = Counter()
    for r in given:
        total[r.source] += r.size
    want = water(total)
    got = mixing.mix(rows).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, r.size) for r in given)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == total[r.source]
        assert int(want[r.source] / total[r.source]) <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in total:
        assert abs(taken[s] - want[s]) <= max(r.size for r in given if r.source == s)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(rows.repartition(7)).collect()))


@pytest.mark.parametrize("most", [100, 3_000, 17_000])
def test_every_source_meets_its_target(spark, most):
    """The sources stay, the largest one grows: one, two and three levels."""
    rng = random.Random(most)
    sizes = {"a": [rng.randrange(1, 400) for _ in range(most)], "b": [*range(1, 100), 3_001], "c": [*(rng.randrange(1, 60) for _ in range(200)), 2_001], "d": [*range(1, 128), 5_003], None: [*range(5, 130), 777, 4_001]}
    rows = [(i, s, n) for s, own in sizes.items() for i, n in enumerate(own)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(rows)
    taken, want = Counter(), water({s: sum(own) for s, own in sizes.items()})
    for r in got:
        taken[r.source] += r.copies * r.size
        assert int(want[r.source] / r.source_size) <= r.copies <= int(want[r.source] / r.source_size) + 1
    assert all(abs(taken[s] - want[s]) <= 10 for s in sizes)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty).count() == 0
    zero = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")).collect()
    assert {(r.doc_id, r.copies, r.target) for r in zero} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_mixing_stage_repeats_rows(spark, docs, corpus):
    out = mixing.stage_mix(spark, docs.withColumn("n", docs.doc_id).withColumn("copies", docs.doc_id), "")
    assert out.columns == [*docs.columns, "n", "copies"]
    taken = Counter()
    for r in out.collect():
        taken[r.source] += len(PLAIN.findall(r.text or ""))
    total = Counter()
    for r in corpus:
        total[r[3]] += len(PLAIN.findall(r[1] or ""))
    for s, t in water(total).items():
        assert abs(taken[s] - t) <= 320


# --- sharding


def test_jump_moves_rows_only_into_the_new_shard():
    keys = sharding.keyed(np.arange(20_000))
    before = sharding.jump(keys, 24)
    after = sharding.jump(keys, 25)
    assert set(after[after != before]) == {24}
    assert abs((after != before).mean() - 1 / 25) < 0.01
    assert np.bincount(before).min() > 700


def test_slots_are_gapless(spark, corpus):
    rows = [(r[0], len(r[1] or ""), 1) for r in corpus] + [(5, 5, 5)] * 40
    df = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long")
    got = sharding.shard(df, "doc_id", 5, ["size", "text_crc32"], chunk_rows=2).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(len({r.shard for r in got if r.doc_id == k}) == 1 for k in {r.doc_id for r in got})


# --- token files


def test_token_files_round_trip(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = tokens.read_files(tokens.write_files(docs, tokens.tokenizer_path(), file_ids=2000)).collect()
    start = 0
    assert len(got) == len(corpus)
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, g in zip(order, sorted(got, key=lambda g: g.start), strict=True):
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(tokens.tokenizer_path()), tokens.WordEncoder(tokens.tokenizer_path()), random.Random(3)
    signs = ["a", "B", "é", "É", "'", "s", "'s", "'LL", ".", ",", "|", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "²", " ", "\n", "\x0b", " ", "́", "̸", "<", "=", "İ", "ß", "Σ", "ς", "中", "🙂", "×", "…", "‍", "\x00", "ﬁ", "K"]
    for _ in range(300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(5)] + [None]
        ids, lengths = e(pa.array(texts, pa.string()))
        assert [list(x) for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_texts_without_white_space_have_no_longest():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(tokens.tokenizer_path()), tokens.WordEncoder(tokens.tokenizer_path()), random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200_000)), "7" * 200_000, "a1b2" * 50_000, "x" * 200_000, "🙂" * 200_000]
    for x in [*texts, texts[0]]:
        ids, lengths = e(pa.array([x, "and so on"], pa.string()))
        want = [[*t.encode(y, add_special_tokens=False).ids, 2] for y in (x, "and so on")]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == want[0] + want[1]
    assert max(map(len, e.known)) > 1 << 16


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 60, n).astype(np.uint32) * 700
    f = tokens.WaveletFile(tokens.encode_file(ids, np.array([5]), np.array([True]), np.array([n])))
    assert (f.tokens() == ids).all()
    for i in rng.integers(0, n, min(n, 20)):
        assert f.access(int(i)) == ids[i]
    for v in {int(x) for x in ids[:5]} | {699}:
        assert f.count(v) == (ids == v).sum() and f.count(v, n // 4, n // 2) == (ids[n // 4 : n // 2] == v).sum()
        assert f.occurrences(v) == np.flatnonzero(ids == v).tolist()
    with pytest.raises(IndexError):
        f.access(n)


# --- urls


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, x) for x in range(1001, 1100)] + [(x, x + 1) for x in range(2000, 2060)] + [(None, 1), (7, None), (9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root}


def test_blocks_reach_aliases(spark):
    pages = [
        (1, "https://a.org/x", '<link rel="canonical" href="https://www.example.com/en/y">'),
        (2, "https://b.org/x#f", "<meta http-equiv='refresh' content='0; url=https://q.net/es/1'>"),
        (3, "https://b.org/x", None),
        (4, "https://www.example.com/en/y", '<link href="https://q.net/es/1" rel=canonical>'),
        (5, None, "<p>"),
        (6, "nohost", None),
        (7, "HTTPS://EXAMPLE.com/en/z?q", ""),
        (8, "https://c.org/p/", '<link rel="canonical" href="/home">'),
        (9, "https://x.example.com", ""),
        (7, "HTTPS://EXAMPLE.com/en/z?q", ""),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got[:4] == [(1, "a.org", "/x", None, "block"), (2, "b.org", "/x", None, "block"), (3, "b.org", "/x", None, "block"), (4, "www.example.com", "/en/y", "www.example.com/en/", "allow")]
    assert [g[4] for g in got[4:]] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert got[9][:4] == (9, "x.example.com", "", None)
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- near duplicates


def brute_classes(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = PLAIN.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (3, 70)])
def test_near_duplicates_by_brute_force(docs, corpus, k, percent):
    got = neardup.classes(docs, k, percent).collect()
    sets, classes = brute_classes(corpus, k, percent)
    assert sorted(r.n for r in got) == sorted(map(len, sets))
    mine, theirs = defaultdict(list), defaultdict(list)
    for r in got:
        if r["class"] is not None:
            mine[r["class"]].append(str(r.doc_id))
    for r, s, c in zip(corpus, sets, classes, strict=True):
        if s:
            theirs[c].append(str(r[0]))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_bands_lose_no_link():
    for percent in (70, 80, 90, 95):
        b = neardup.bands(percent)
        for a in range(1, 1500):
            top = a * 100 // percent
            assert set(b.sets(a)) & set(b.sets(top))
            band = b.band(a)
            assert b.band(top) in (band, band + 1)
            assert b.most_apart(a + top) <= b.sizes(band)[0]


def test_fine_sketch_bounds_difference():
    rng, b = np.random.default_rng(1), neardup.bands(90)
    x = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    for change in (0, 1, 5, 40):
        y = np.unique(np.concatenate([x[change:], rng.integers(0, 2**63, change).astype(np.uint64)]))
        s = [np.frombuffer(neardup.fine_sketch(v, b.band(300), b), np.uint64) for v in (x, y)]
        assert neardup._apart(*s) <= 2 * change


def test_stage_keeps_one_of_each_group(spark, docs, corpus):
    kept = neardup.stage_neardup(spark, docs.withColumn("node", docs.n_chars).withColumn("h", docs.n_chars), "")
    assert kept.columns == [*docs.columns, "node", "h"]
    sets, classes = brute_classes(corpus, 5, 80)
    empty = sum(not s for s in sets)
    rows = kept.collect()
    assert len(rows) == len({c for c, s in zip(classes, sets, strict=True) if s}) + empty
    assert 8 in {r.doc_id for r in rows} and not {9, 10, 11, 12} & {r.doc_id for r in rows}


def test_near_duplicates_of_nothing(none):
    assert neardup.classes(none, 3, 90).count() == 0


# --- lines


def test_recurring_lines(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, 12)}\nPage {i} of 99 in our public archive.\n{prose(rng, 9)}" for i in range(12)] + ["only one line of text that nobody else has", "", None]
    docs = lines.keyed(spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string"))
    drop, recur = lines.recurring(docs)
    assert {(r.doc_id, r.line) for r in drop.collect()} == {(i, 1) for i in range(12)}
    assert [r.example for r in recur.collect()] == ["Page <*> of <*> in our public archive."]
    left = {r.doc_id: r for r in lines.without_lines(docs, drop).collect()}
    assert left[0].text == "\n".join(texts[0].split("\n")[::2]) and left[0].n_dropped == 1
    assert left[12].text == texts[12] and left[13].text == "" and left[14].text is None


def test_variable_words_become_fields(spark):
    rng = random.Random(6)
    texts = [f"{prose(rng, 15)}\nWe are glad that you {rng.choice('abcdefghij')}{i}x came to this place again." for i in range(9)]

    drop, recur = lines.recurring(lines.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert drop.count() == 9


def test_same_lines_of_two_texts(spark):
    """Word for word in two texts: dropped, digits or not; with other digits, in fewer than five texts, or short: not."""
    rng = random.Random(8)
    passage, dated = prose(rng, 60), "Signed on 3 May 1999 by 12 members of council 7"
    short = "See also this page"
    texts = [f"{prose(rng, 20)}\n{passage}\n{short}", f"{passage}\n{prose(rng, 20)}\n{short}", f"{dated}\n{prose(rng, 20)}", f"{prose(rng, 20)}\n{dated}"]
    texts += [f"{prose(rng, 20)}\nSold on {i} May among {i} of us here now" for i in range(4)]
    rows = [*enumerate(texts), (90, f"{prose(rng, 20)}\none text that repeats as a row"), (2, texts[2])]
    rows.append((91, rows[-2][1]))
    drop, _ = lines.recurring(lines.keyed(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r.doc_id, r.line) for r in drop.collect()} == {(0, 1), (1, 0), (2, 0), (3, 1)}


def test_lines_of_one_text_count_once(spark):
    """A leaf of six texts; five lines of one of them agree in a fifth token, and three texts' lines make up five of another."""
    head = "entry in the list"
    glossary = "\n".join(f"{head} common {a}" for a in ("red", "blue", "green", "white", "black"))
    three = ["\n".join(f"{head} shared {a}{k}" for a in ("x", "y")) for k in "abc"]
    texts = [glossary, *three, f"{head} other one", f"{head} another two"]
    drop, _ = lines.recurring(lines.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert drop.count() == 0
    more = [*texts, f"{head} shared {'z'}d", f"{head} shared {'z'}e"]
    drop, recur = lines.recurring(lines.keyed(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")))
    assert {r.doc_id for r in drop.collect()} == {1, 2, 3, 6, 7} and [r.n_texts for r in recur.collect()] == [5]


def test_lines_of_nothing(none):
    docs = lines.keyed(none)
    drop, _ = lines.recurring(docs)
    assert lines.without_lines(docs, drop).count() == 0


# --- personal data


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    return sorted((m.start(), pii.KINDS.index(k), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if ok[k](m[0]))


def test_base_spans_by_brute_force():
    rng = random.Random(4)
    parts = ["a@b.co", "x.y+z@d-e.f.g", "@", "a@b", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456-78", "+1", "+12345678901234567", "99", " ", "-", ".", "ü", "\n", "DE89 3704 0044 0532 0130 00"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert [(a, pii.KINDS.index(k), b) for a, b, k, _ in pii.spans(text) if k in pii.BASE] == brute_spans(text)


def test_checksums_and_context():
    assert [s[2] for s in pii.spans("IBAN: DE89 3704 0044 0532 0130 00")] .count("iban") == 1
    assert not [s for s in pii.spans("DE88 3704 0044 0532 0130 00") if s[2] == "iban"]
    assert [s[2] for s in pii.spans("Steuer 86095742719")] == ["tax"] and not pii.spans("Nummer 86095742719")
    assert pii.masked("Mail a@b.co now") == "Mail [email] now" and pii.masked(None) is None and pii.spans("") == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000):
        pii.spans(text)


# --- quality


def test_quality_figures_by_brute_force(corpus):
    texts = [r[1] for r in corpus] + ["a b c a b c # $\n\nx\nx", "é " * 60]
    for t, g in zip(texts, quality.figures(pa.array(texts, pa.string())).to_pylist(), strict=True):
        t = t or ""
        w = PLAIN.findall(t)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        seen = [x for x in t.split("\n") if PLAIN.search(x)]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(seen) - len(set(seen)), len(hit))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (g["base_failed"] and g["kept"])


def test_compression_bands():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    good = prose(rng, 900, words)
    repeated = " ".join(f"{w} {i % 3}" for i, w in enumerate(words[:12] * 500))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(60)) for i in range(90))
    got = quality.figures(pa.array([good, repeated, noise])).to_pylist()
    assert got[0]["kept"] and not got[1]["kept"] and not got[2]["kept"]
    assert not got[2]["base_failed"] and got[2]["ratio"] < 1.5


# --- languages


def test_language_accuracy_on_held_out_pages(spark):
    rng = random.Random(8)
    vocab = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(3, 9))) for _ in range(300)] for x, a in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnab"))}
    docs = spark.createDataFrame([(prose(rng, 60, vocab[x]), x) for x in vocab for _ in range(15)] + [(None, "aa"), ("text", None)], "text string, lang string")
    truth, rows = {}, []
    for i in range(120):
        x = rng.choice(list(vocab))
        truth[i] = x
        said = f' lang="{x}"' if rng.random() < 0.8 else ""
        body = prose(rng, 40, vocab[x]) if i % 10 else ""
        rows.append((i, f"https://www.host-{x}.org/{i}", f"<html{said}><head><title>t</title></head><body><p>{body}</p></body></html>"))
    rows += [(900, None, None), (901, "nohost", "")]
    got = {r.page_id: r for r in langid.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].lang == x for i, x in truth.items()) >= 0.97 * len(truth)
    assert got[10].text_lang is None and got[10].lang == truth[10]


def test_languages_of_nothing(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c", "<html lang=de>x</html>")], "page_id long, url string, html string")
    docs = spark.createDataFrame([], "text string, lang string")
    assert [r.lang for r in langid.identified(pages, docs).collect()] == [None]


def test_fine_sketches_are_short_and_bound_the_difference_from_below():
    from lucidtext.llm.neardup import bands, fine_sketch

    rng = np.random.default_rng(5)
    b = bands(80)
    for n in (40, 300, 2000):
        tokens = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for k in (1, n // 10, n // 5):
            other = np.concatenate([tokens[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)])
            x, y = (np.frombuffer(fine_sketch(t, b.band(n), b), np.uint64) for t in (tokens, other))
            assert x.nbytes * 8 <= 2 * n + 64
            assert np.bitwise_count(x ^ y).sum() <= 2 * k


def test_pairs_that_nearly_link_leave_no_row_each(spark, monkeypatch):
    """Copies of one text that are all a little too far apart to link: larger sketches turn most pairs down where they are found."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(404)]
    docs = []
    for k in range(60):
        words = list(base)
        for i in rng.choice(404, 6, replace=False):
            words[i] = f"x{k}y{i}"
        docs.append((k, " ".join(words)))
    seen = []
    original = neardup.written

    def written(df, name, *more):
        out = original(df, name, *more)
        if name == "crossing":
            seen.append(out.where("a IS NOT NULL").count())
        return out

    monkeypatch.setattr(neardup, "written", written)
    found = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()
    _, want = brute_classes([(k, t, None) for k, t in docs], 5, 80)
    same = {}
    for r in found:
        same.setdefault(r["class"], set()).add(r.doc_id)
    brute = {}
    for (k, _), c in zip(docs, want, strict=True):
        brute.setdefault(c, set()).add(k)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, brute.values()))
    assert seen and seen[-1] < 200  # there are 1,770 pairs


def test_groups_of_pairs():
    i, j = np.array([1, 4, 2, 6]), np.array([4, 2, 5, 7])
    assert neardup._grouped(i, j, 8).tolist() == [0, 1, 1, 3, 1, 1, 6, 6]
    assert neardup._grouped(i[:0], j[:0], 2).tolist() == [0, 1]
