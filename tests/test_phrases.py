"""Phrases in texts against brute force; idioms whose words differ a little."""

import random
import re

import pytest

from lucidtext.functions import lexicons as L
from lucidtext.operators import phrases, rules
from lucidtext.operators.annotate import Annotated

IDIOMS = [
    ("Er wollte uns einen Bären aufbinden.", "jemandem einen bären aufbinden"),
    ("Sie hat die Flinte ins Korn geworfen.", "die flinte ins korn werfen"),
    ("Er wird das Handtuch werfen.", "das handtuch werfen"),
    ("Wir wollen wirklich das Handtuch werfen.", None),
    ("Er sieht das Handtuch.", None),
    ("Da geht das Handtuch. Werfen wir es?", None),
    ("Das müssen wir unter vier Augen besprechen.", "unter vier augen"),
    ("Unter acht Augen geht es nicht.", None),
]


def test_idioms_by_share(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(IDIOMS)], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.check_rule(Annotated(docs), "redewendungen").collect()}
    for k, (text, idiom) in enumerate(IDIOMS):
        assert (got[k].term if k in got else None) == idiom
        if idiom:
            assert len(re.findall(r"\w+", text[got[k].t_start : got[k].t_end])) == len(idiom.split())


def test_animals_make_an_idiom_likelier(spark):
    docs = spark.createDataFrame([(1, "Er ist über den Berg sein."), (2, "Hund und Katze, über den Berg sein.")], "doc_id long, text string")
    got = rules.check_rule(Annotated(docs), "redewendungen").collect()
    assert [(r.doc_id, "Priorität: hoch" in r.message) for r in got] == [(2, True)]


def test_metaphors_as_given(spark):
    texts = ["Mit vielen Mosaiksteinen.", "Das sind Mammutaufgaben.", "Das Herz ist übervoll.", "(Herz  ist gut)", "Das Schmerzherz ist krank.", "Spreu vom Weizen trennen."]
    got = rules.check_rule(Annotated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "redewendungen").collect()
    assert sorted((r.doc_id, r.term) for r in got) == [(0, "mosaiksteine"), (1, "mammutaufgabe"), (2, "herz ist übervoll"), (3, "herz  ist gut"), (5, "spreu vom"), (5, "weizen trennen")]


def test_number_words_are_the_whole_list():
    assert len(L.NUMBER_WORDS) == len(set(L.NUMBER_WORDS)) == 326
    assert {"null", "zwei", "dritte", "zwölfmal", "einundzwanzigste", "fünfzigstes", "achtzigste", "hundert", "tausend", "million", "milliarden", "hälfte", "drittel", "viertels", "hundertstel"} <= set(L.NUMBER_WORDS)


def test_all_number_words_are_flagged(spark):
    docs = spark.createDataFrame([(k, f"Ich sehe {w} davon. {w.capitalize()}!") for k, w in enumerate(L.NUMBER_WORDS)] + [(1000, "Elf und acht von einer Million sind ein Drittel von tausend.")], "doc_id long, text string")
    got = rules.check_rule(Annotated(docs), "zahlwoerter").collect()
    assert {k: sum(r.doc_id == k for r in got) for k in range(326)} == dict.fromkeys(range(326), 2)
    assert sorted(r.term for r in got if r.doc_id == 1000) == ["Drittel", "Million", "tausend"]


@pytest.mark.parametrize("ratio", [0.6, 0.8, 1.0])
def test_windows(spark, ratio):
    rng = random.Random(int(10 * ratio))
    lexicon = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 9))] for _ in range(25)] + [["x"], ["etwas", "a"], ["etwas"], []]
    texts = [None, "", ". .", "x"] + ["".join(rng.choice("abcdefg") + rng.choice([" ", " ", " ", ", ", ". ", " - "]) for _ in range(rng.randrange(60))) for _ in range(40)]
    want = []
    for doc, text in enumerate(texts):
        for m in re.finditer(r"[^.]+", text or ""):
            ws = [(w.start(), w.group()) for w in re.finditer(r"[a-z]", m[0])]
            for p, own in enumerate(lexicon):
                for i in range(len(ws) - len(own) + 1):
                    hits = sum(x in ("etwas", w) for x, (_, w) in zip(own, ws[i:], strict=False))
                    if own and hits >= ratio * len(own) - 1e-9 and any(x != "etwas" for x in own):
                        want.append((doc, p, m.start() + ws[i][0], hits))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(lexicon)), "phrase_id long, words array<string>")
    got = phrases.agreeing(docs, given, ratio, ("etwas",)).collect()
    assert sorted((r.doc_id, r.phrase_id, r.t_start, r.hits) for r in got) == sorted(want)


def test_contained(spark, monkeypatch):
    rng = random.Random(1)
    lexicon = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6))) for _ in range(30)] + ["ä", "", None]
    lexicon = list(dict.fromkeys(lexicon))
    texts = [None, "", "Ä"] + ["".join(rng.choice("abAB ") for _ in range(50)) for _ in range(20)]
    want = [(d, k, sum(t.lower()[i:].startswith(p) for i in range(len(t))), t.lower().find(p)) for d, t in enumerate(texts) if t for k, p in enumerate(lexicon) if p and p in t.lower()]
    docs, given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(lexicon)), "phrase_id long, phrase string")
    for block in (phrases.BLOCK, 7):
        monkeypatch.setattr(phrases, "BLOCK", block)
        assert sorted(map(tuple, phrases.contained(docs, given).collect())) == sorted(want)


def test_complex_words_with_suggestions(spark):
    docs = spark.createDataFrame([(1, "Das Konzept ist effektiv."), (2, "Die Familie kommt."), (3, "Die Biologie kommt.")], "doc_id long, text string")
    got = rules.check_rule(Annotated(docs), "komplexitaet").collect()
    assert sorted((r.doc_id, r.term) for r in got) == [(1, "Konzept"), (1, "effektiv"), (3, "Biologie")]
    assert {r.message for r in got if r.term == "Konzept"} == {'Fremdwort: "Konzept" (Fremdwort: bekanntes schwieriges Wort). Besser: "Plan, Idee"'}
    assert len(L.COMPLEX_WORDS) == 120 and len(L.SIMPLE_WORDS) == len(set(L.SIMPLE_WORDS)) > 200
