"""The smoothed trigram model against its formulas in dictionaries; joins that frequent keys don't slow down."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lucidtext.operators import joins, language_model as lm


def cut(text):
    for no, m in enumerate(re.finditer(r"[^.!?]+[.!?]*|[.!?]+", text or ""), 1):
        ws = re.findall(r"[a-zäöü]+|[.,!?]", m[0].lower())
        if len(ws) >= 3:
            yield no, ws


def grams(ws):
    p = ["<s>", "<s>", *ws, "</s>"]
    return [tuple(p[i : i + 3]) for i in range(len(p) - 2)]


class ByHand:
    def __init__(self, texts, d):
        self.d, self.c = d, Counter(g for t in texts for _, ws in cut(t) for g in grams(ws))
        self.n2, self.n1 = defaultdict(set), defaultdict(set)
        for a, b, w in self.c:
            self.n2[b, w].add(a)
        for b, w in self.n2:
            self.n1[w].add(b)
        self.words = sorted(self.n1)

    def p(self, a, b, w):
        own = {x: n for (y, z, x), n in self.c.items() if (y, z) == (a, b)}
        return (max(own.get(w, 0) - self.d, 0) + self.d * len(own) * self.p2(b, w)) / sum(own.values()) if own else self.p2(b, w)

    def p2(self, b, w):
        own = {x: len(s) for (y, x), s in self.n2.items() if y == b}
        p1 = len(self.n1.get(w, ())) / len(self.n2)
        return (max(own.get(w, 0) - self.d, 0) + self.d * len(own) * p1) / sum(own.values()) if own else p1


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["der", "die", "hund", "katze", "geht", "läuft", "und", "schnell"])
    return [None, "", "zu kurz.", *(" ".join(word() for _ in range(rng.randrange(2, 9))) + rng.choice([".", "!", ", ja.", "? Und der Hund geht."]) for _ in range(25))]


@pytest.mark.parametrize("sent", [joins.SENT_ROWS, 0])
def test_probabilities(spark, texts, monkeypatch, sent):
    monkeypatch.setattr(joins, "SENT_ROWS", sent)
    monkeypatch.setattr(joins, "FREQUENT", 20)  # some keys are frequent here
    docs = spark.createDataFrame([(k % 4, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model, hand = lm.fitted(docs, 0.4), ByHand(texts, 0.4)
    contexts = sorted({(a, b) for a, b, _ in hand.c})[:25] + [("neu", "hund"), ("neu", "neu"), ("hund", "</s>")]
    asked = [(a, b, w) for a, b in contexts for w in [*hand.words, "nie"]]
    got = {(r.w1, r.w2, r.w3): r.p for r in model.probabilities(spark.createDataFrame(asked, "w1 string, w2 string, w3 string")).collect()}
    assert len(got) == len(asked)
    for a, b in contexts:
        assert sum(got[a, b, w] for w in hand.words) == pytest.approx(1)
        assert got[a, b, "nie"] == 0
        for w in hand.words:
            assert got[a, b, w] == pytest.approx(hand.p(a, b, w))


def test_perplexities(spark, texts, tmp_path):
    rows = [(k % 4 if k % 5 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hand = ByHand(texts[:20], lm.DISCOUNT)
    lm.fitted(docs.where("text IS NOT NULL").limit(0).unionByName(spark.createDataFrame(rows[:20], "doc_id long, text string"))).save(f"{tmp_path}/model")
    model = lm.Model.load(spark, f"{tmp_path}/model")
    want = []
    for doc_id, t in [*rows, (9, "Der Esel geht schnell.")]:
        for no, ws in cut(t):
            ps = [hand.p(*g) for g in grams(ws)]
            want.append((doc_id, no, len(ps), None if 0 in ps else -sum(map(math.log, ps)) / len(ps)))
    got = lm.perplexities(docs.unionByName(spark.createDataFrame([(9, "Der Esel geht schnell.")], docs.schema)), model).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3] or 0, 6), r[3] is None)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert [r.log_perplexity for r in got if r.doc_id == 9] == [None]


@pytest.mark.parametrize("sent", [joins.SENT_ROWS, 0])
def test_own_trigrams(spark, texts, monkeypatch, sent):
    monkeypatch.setattr(joins, "SENT_ROWS", sent)
    monkeypatch.setattr(joins, "FREQUENT", 20)
    monkeypatch.setattr(lm, "FREQUENT", 20)
    docs = spark.createDataFrame([(k % 4, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    hand = ByHand(texts, 0.4)
    got = {(r.w1, r.w2, r.w3): (r.n, r.p) for r in lm.of_all(docs, 0.4).collect()}
    assert {g: n for g, (n, _) in got.items()} == dict(hand.c)
    assert all(p == pytest.approx(hand.p(*g)) for g, (_, p) in got.items())
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6))
    want = lm.perplexities(docs, lm.fitted(docs, 0.4))
    assert sorted(map(key, lm.own_perplexities(docs, 0.4).collect())) == sorted(map(key, want.collect()))


def test_few_tables_of_all_trigrams(spark, texts, monkeypatch):
    """Trigrams are written once, however many sums they need; before, seven times."""
    written = []
    monkeypatch.setattr(lm, "through_folder", lambda df, name, real=lm.through_folder: (written.append(name), real(df, name))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm.of_all(docs).count() and written == ["trigrams", "singles", "words"]


def test_no_sentences(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert lm.perplexities(docs, lm.fitted(docs)).count() == 0


def test_own_of_no_sentences(spark):
    assert lm.own_perplexities(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


def test_looked_up_keeps_all_rows(spark, monkeypatch):
    big = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)] + [(None, 1000), (99, 1001)], "key int, v int")
    small = big.where("key IS NOT NULL AND key <> 99").groupBy("key").count().withColumnRenamed("count", "rows").selectExpr("key", "key * 2 AS twice", "rows")
    want = sorted((str(r.key), r.v, str(None if r.key in (None, 99) else 2 * r.key)) for r in big.collect())
    for sent, often in ((1000, 10_000), (0, 10_000), (0, 5)):
        monkeypatch.setattr(joins, "SENT_ROWS", sent)
        monkeypatch.setattr(joins, "FREQUENT", often)
        assert sorted((str(r.key), r.v, str(r.twice)) for r in joins.looked_up(big, small, ["key"], "rows").collect()) == want


def test_own_trigrams_are_asked_for_once_by_a_batch(spark, texts, monkeypatch):
    """Not once for each sentence; and tables go once the next one stands, so that disk holds few of them at once."""
    import os

    files = {}

    def through(df, name, real=lm.through_folder):
        files[name] = (out := real(df, name)).inputFiles()
        return out

    docs = spark.createDataFrame([(k % 4 if k % 5 else None, t) for k, t in enumerate(texts * 20)], "doc_id long, text string").repartition(2)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    want = sorted(map(key, lm.perplexities(docs, lm.fitted(docs)).collect()))
    asked = lm._of_batches(docs).where("at IS NOT NULL")
    assert asked.count() == asked.select("batch", *lm.GRAM).distinct().count() < lm.of_sentences(docs).count() / 2
    monkeypatch.setattr(lm, "through_folder", through)
    assert sorted(map(key, lm.own_perplexities(docs).collect())) == want
    stand = {name: [os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in own] for name, own in files.items()}
    assert all(stand["scored"]) and not any(x for name in ("trigrams", "singles", "words", "known") for x in stand[name])
