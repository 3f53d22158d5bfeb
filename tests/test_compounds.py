"""Cuts of words against all cuts; pieces against all substrings."""

import itertools
import math
import random

import pytest

from lucidtext.operators import compounds as C, joins


def all_cuts(word, counts, total, variant):
    """Every way to write a word as known pieces with linking sounds between them: the best by the variant's cost."""
    best = None

    def go(at, path, links):
        nonlocal best
        if at == len(word):
            if len(path) > 1 and (variant != "conservative" or len(path) == 2):
                costs = [C.COSTS[variant](word[a:b], counts[word[a:b]], total) for a, b in path]
                if all(x[0] != math.inf for x in costs):
                    own = (round(sum(x[0] for x in costs) + (C.LINK_COST * links if variant in ("frequent", "conservative") else 0), 6), round(sum(x[1] for x in costs), 6), path)
                    best = min(best, own) if best else own
            return
        for b in range(at + C.LEAST_PART, len(word) + 1):
            if counts.get(word[at:b], 0) >= C.MIN_COUNT and b - at < len(word):
                for link in C.LINKS:
                    if word.startswith(link, b) and not (link and b + len(link) > len(word) - C.LEAST_PART):
                        go(b + len(link), [*path, (at, b)], links + bool(link))

    go(0, [], 0)
    return [word[a:b] for a, b in best[2]] if best else [word]


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(3)
    base = ["haus", "tier", "arzt", "arbeit", "geber", "leistung", "bund", "land", "landes", "regierung", "kranken", "kasse", "stadt", "staat", "anwalt", "anwaltschaft"]
    out = {w: rng.randrange(2, 200) for w in base}
    for a, b in itertools.product(base, base):
        out.setdefault(a + rng.choice(C.LINKS) + b, rng.randrange(1, 3))
    for _ in range(60):
        out.setdefault("".join(rng.choice(base) + rng.choice(C.LINKS) for _ in range(3)) + rng.choice(base), 1)
    return out | {"kurz": 5, "unbekanntes": 1, "x" * 30: 1}


@pytest.mark.parametrize("sent", [joins.SENT_ROWS, 0])
def test_cuts(spark, counts, monkeypatch, sent):
    monkeypatch.setattr(joins, "SENT_ROWS", sent)
    monkeypatch.setattr(joins, "FREQUENT", 30)
    got = {r.word: r for r in C.split(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)).collect()}
    total = sum(counts.values())
    for word in counts:
        want = {v: all_cuts(word, counts, total, v) for v in C.COSTS} if len(word) >= C.LEAST_WORD else {}
        if any(len(x) > 1 for x in want.values()):
            assert {v: got[word][v] for v in C.COSTS} == want, word
            assert got[word].n == counts[word]
        else:
            assert word not in got


def test_no_words(spark):
    assert C.split(spark.createDataFrame([], "word string, n long")).count() == 0
    assert C.split(spark.createDataFrame([("kurz", 3)], "word string, n long")).count() == 0
