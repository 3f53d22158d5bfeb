"""Predicates on Arrow columns give what DuckDB gives for the same SQL."""

import random

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lucidtext.functions import lexicons as L
from lucidtext.functions.predicates import compiled, evaluated
from lucidtext.operators import rules


def words():
    rng = random.Random(1)
    given = [*L.NUMBER_WORDS[:40], *L.COMMON_WORDS[:40], *(w for w, *_ in L.FOREIGN_WORDS), *L.SUBJUNCTIVE_FORMS, *L.TITLE_ABBREVIATIONS, "GmbH", "E-Mail-Adresse", "XIV", "XIX", "·", "…", "§", "½", "'", ",", "7", "Ünwohl", "unfrei", "planlos", "Globalisierungstendenz"]
    given += ["".join(rng.choice("aeiounrstäöüßgehKLM-") for _ in range(rng.randrange(1, 20))) for _ in range(400)]
    given += [w.capitalize() for w in given]
    return list(dict.fromkeys(given))


@pytest.fixture(scope="module")
def columns():
    text = pa.array(words())
    kind = ["w" if w[0].isalpha() else "d" if w[0].isdigit() else "p" for w in words()]
    return {"text": text, "lower": pc.utf8_lower(text), "kind": pa.array(kind), "n_syll": pc.count_substring_regex(pc.utf8_lower(text), "[aeiouäöü]+").to_numpy()}


def test_all_word_predicates(columns):
    given = pa.table({**columns, "k": range(len(columns["text"]))})  # noqa: F841  read by DuckDB
    want = rules.wanted(rules.RULES)
    asked = [p for _, p in want.words] + [p for _, p in want.counts] + [want.syllables, want.long, want.foreign, rules.foreign_score(), rules.complexity_bonus()]
    for sql in asked:
        theirs = [x for (x,) in duckdb.sql(f"SELECT {rules.duck_sql(sql)} FROM given ORDER BY k").fetchall()]
        assert evaluated(sql, columns).tolist() == theirs, sql


@pytest.mark.parametrize("sql", ["text ~ 'x'", "length(text", "kind = 'w' AND", "nothing_like(text)"])
def test_what_is_not_understood_is_an_error(sql):
    with pytest.raises((ValueError, KeyError, IndexError)):
        compiled(sql)


def test_counts_and_first_places(spark):
    from lucidtext.operators.annotate import Annotated
    from lucidtext.operators.findings import Wanted, findings

    want = Wanted(words=(("short", "length(text) = 1"), ("x", "lower = 'x'")), tokens=("x",), once=(("x",),), counts=(("n", "kind = 'w'"),), sentences=True)
    docs = spark.createDataFrame([(1, "X y. x x!"), (1, "x"), (2, None), (3, "")], "doc_id long, text string")
    rows = findings(Annotated(docs).docs, Wanted(**{**want.__dict__, "counts": (("n_words", "kind = 'w'"),)})).collect()
    tokens = sorted((r.doc_id, r.t_start, r.first != 0, r.n) for r in rows if r.what == "t")
    assert tokens == [(1, 0, True, 1), (1, 0, True, 3), (1, 5, False, 0), (1, 7, False, 0)]
    assert sorted((r.sent_no, r.n_words) for r in rows if r.what == "s") == [(1, 1), (1, 2), (2, 2)]
