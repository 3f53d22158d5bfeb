"""Word vectors against their formula, neighbours against all pairs, groups by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidtext.operators import joins, word_vectors as W


def texts():
    rng = random.Random(6)
    like = {"Hund": "bellt läuft frisst Knochen", "Dackel": "bellt läuft frisst Knochen", "Auto": "fährt hupt bremst Straße", "Wagen": "fährt hupt bremst Straße"}
    out = [None, "", "!"]
    for _ in range(60):
        w = rng.choice(sorted(like))
        out.append(f"{w} {' '.join(rng.choice(like[w].split()) for _ in range(3))}. Dann {rng.choice('abcd')} kommt {w}, {rng.choice(like[w].split())}!")
    return out


def by_hand(rows):
    import re

    n, near = Counter(), Counter()
    for t in rows:
        for s in re.findall(r"[^.!?]+", t or ""):
            ws = re.findall(r"[^\W\d_]+", s)
            for i, w in enumerate(ws):
                if w[0].isupper() and len(w) > 3:
                    n[w.lower()] += 1
                    for j in range(max(0, i - W.WINDOW), min(len(ws), i + W.WINDOW + 1)):
                        if j != i:
                            near[w.lower(), ws[j].lower()] += 1
    near = {k: v for k, v in near.items() if n[k[0]] >= W.MIN_COUNT}
    total, of_w, of_c = sum(near.values()), Counter(), Counter()
    for (w, c), v in near.items():
        of_w[w] += v
        of_c[c] += v
    return n, {k: x for k, v in near.items() if (x := math.log(v * total) - math.log(of_w[k[0]]) - math.log(of_c[k[1]])) > 0}


@pytest.mark.parametrize("sent", [joins.SENT_ROWS, 0])
def test_vectors(spark, monkeypatch, sent):
    monkeypatch.setattr(joins, "SENT_ROWS", sent)
    monkeypatch.setattr(joins, "FREQUENT", 10)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4)
    n, ppmi = by_hand(texts())
    signs = {r.c: np.unpackbits(np.array([r.a, r.b], "<i8").view(np.uint8)) * 2.0 - 1 for r in spark.createDataFrame([(c,) for c in {c for _, c in ppmi}], "c string").select("c", F.xxhash64(F.lit(1), "c").alias("a"), F.xxhash64(F.lit(2), "c").alias("b")).collect()}
    got = {r.word: (r.n, np.frombuffer(r.vector, "<f4")) for r in W.vectors(docs).collect()}
    assert set(got) == {w for w, _ in ppmi}
    for w, (times, v) in got.items():
        want = sum(x * signs[c] for (own, c), x in ppmi.items() if own == w)
        assert times == n[w] and np.allclose(v, want / np.linalg.norm(want), atol=1e-5)
    pairs = {(r.word, r.other) for r in W.neighbours(W.vectors(docs)).collect()}
    assert {("hund", "dackel"), ("dackel", "hund"), ("auto", "wagen")} <= pairs and ("hund", "auto") not in pairs


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(300, W.SIZE))
    x = (centre[rng.integers(0, 300, 3000)] + rng.normal(0, 0.75, (3000, W.SIZE))).astype("<f4")
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(f"w{k:04d}", v.tobytes()) for k, v in enumerate(x)]
    c = x @ x.T
    np.fill_diagonal(c, 0)
    want = {(f"w{a:04d}", f"w{b:04d}") for a, b in zip(*np.nonzero(c >= W.SIMILAR), strict=True)}
    return spark.createDataFrame(rows, "word string, vector binary"), want


def test_exact_neighbours(many, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 700)
    df, want = many
    assert len(want) > 3000
    got = [(r.word, r.other) for r in W.neighbours(df, exact=True).collect()]
    assert len(got) == len(set(got)) and len(set(got) ^ want) <= len(want) // 1000  # products at the very limit


def test_recall_of_the_index(many):
    df, want = many
    got = [(r.word, r.other) for r in W.neighbours(df).collect()]
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.9 * len(want) and len(set(got) - want) <= len(want) // 1000


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "kein Wort hier")], "doc_id long, text string")
    found = W.vectors(docs)
    assert found.count() == 0 and W.neighbours(found).count() == 0 and W.clusters(docs, found, W.neighbours(found)).count() == 0


def test_clusters(spark):
    """Seeds in order of first place; a word belongs to one group; rows of one id stay apart; the plainest is best."""
    docs = spark.createDataFrame([(1, "Haus Villa Hütte. Berg Hügel."), (1, "Villa und Berg."), (None, "Hütte, Haus, Villa. Haus Villa!"), (3, None)], "doc_id long, text string")
    found = spark.createDataFrame([("haus", 900), ("villa", 50), ("hütte", 50), ("berg", 100), ("hügel", 100)], "word string, n long")
    both = lambda *ps: [x for a, b in ps for x in ((a, b), (b, a))]
    pairs = spark.createDataFrame(both(("haus", "villa"), ("villa", "hütte"), ("berg", "hügel")), "word string, other string")
    got = sorted(((str(r.doc_id), r.words, r.best) for r in W.clusters(docs, found, pairs).collect()))
    assert got == [("1", ["berg", "hügel"], "berg"), ("1", ["haus", "villa"], "haus"), ("None", ["hütte", "villa"], "hütte")]


def test_quality(spark):
    words = [("Haus", 0.01), ("Dokumentation", 0.00005), ("Wohnung", 0.0), ("E-Bike", 0.002)]
    got = {r.w: round(r.q, 6) for r in spark.createDataFrame(words, "w string, s double").select("w", W.quality(F.col("w"), F.col("s")).alias("q")).collect()}
    assert got == {"Haus": 0.8, "Dokumentation": 0.2, "Wohnung": 0.4, "E-Bike": 0.6}


def test_nearest_centres_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(5_000, W.SIZE)).astype("<f4"), rng.normal(size=(1_024, W.SIZE)).astype("<f4")
    want = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :12]
    tracemalloc.start()
    got = W.nearest(x, c, 12)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all vectors against all centres at once took 60 MB
    assert most < 10e6 and (got == want).all(1).mean() > 0.999
    assert W.nearest(x[:3], c[:2], 12).shape == (3, 2) and W.nearest(x[:0], c, 12).shape == (0, 12)
