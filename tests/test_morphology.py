"""Tags and lemmas: decoding against all sequences, genitives and subjunctives by class."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lucidtext.operators import morphology as M
from lucidtext.operators.annotate import Scanned


def batch(texts):
    return Scanned(pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]))


def test_best_sequence_of_all():
    rng = np.random.default_rng(2)
    between = rng.random((len(M.TAGS) + 1, len(M.TAGS)))
    sizes = np.array([3, 1, 5, 4, 2])
    tag = rng.integers(0, len(M.TAGS), (sizes.sum(), M.MOST))
    cost = rng.random(tag.shape)
    cost[rng.random(tag.shape) < 0.3] = np.inf
    cost[:, 0] = rng.random(len(cost))
    got, at = M.decoded(tag, cost, sizes, between), 0
    for n in sizes:
        def total(path, at=at):
            ts = [len(M.TAGS), *(tag[at + i, j] for i, j in enumerate(path))]
            return sum(cost[at + i, j] for i, j in enumerate(path)) + sum(between[a, b] for a, b in zip(ts, ts[1:], strict=False))

        best = min(itertools.product(range(M.MOST), repeat=int(n)), key=total)
        assert tuple(got[at : at + n]) == best
        at += n


def test_longest_suffix():
    trie = M.Trie({"": ("none",), "e": ("e",), "ste": ("ste",), "xste": ("x",)})
    assert [trie(w)[0] for w in ("a", "e", "be", "aste", "ste", "bxste", "xste")] == ["none", "none", "e", "ste", "e", "x", "ste"]
    assert all(len(M.candidates(w, f)) in range(1, M.MOST + 1) for w in ("der", "Haus", "gelesen", "x", "7", ".", "Übung", "ß") for f in (True, False))


def test_lemmas():
    s = batch(["Das Dach des Hauses war rot.", "Er sagte, sie könne gehen."])
    _, lemma = M.analysed(s, M.costs(M.first_counts()))
    assert {"Haus", "sein", "sagen", "können", "gehen"} <= set(lemma)


GENITIVES = [
    ("Das Auto des Nachbarn steht vor der Tür.", [("des Nachbarn", "Genitiv-Konstruktion")]),
    ("Die Qualität der guten Arbeit ist wichtig.", [("der guten Arbeit", "Genitiv-Konstruktion")]),
    ("Peters Fahrrad ist rot.", [("Peters", "Sächsischer Genitiv")]),
    ("Deutschlands Wirtschaft wächst.", [("Deutschlands", "Sächsischer Genitiv")]),
    ("Wegen des Regens bleiben wir hier.", [("des Regens", "Präpositionaler Genitiv")]),
    ("Wir gedenken der Opfer.", [("der Opfer", "Verbal-regierter Genitiv")]),
    ("Er ist sich seiner Schuld bewusst.", [("seiner Schuld", "Adjektiv-regierter Genitiv")]),
    ("Mit der Bahn fahre ich zur Arbeit.", []),
    ("Der Mann geht in die Stadt.", []),
]
SUBJUNCTIVES = [
    ("Er sagte, er sei krank.", [("sei", "Konjunktiv I", "Indirekte Rede")]),
    ("Sie glaubt, dass er komme.", [("komme", "Konjunktiv I", "Indirekte Rede")]),
    ("Wenn ich reich wäre, hätte ich ein Haus.", [("wäre", "Konjunktiv II", "Irrealis (Bedingung)"), ("hätte", "Konjunktiv II", "Irrealis (Hypothese)")]),
    ("Ich würde gehen.", [("würde", "Würde-Konstruktion (Konjunktiv II)", "Hypothese/Konditionalis")]),
    ("Das könnte helfen.", [("könnte", "Konjunktiv II (Modal)", "Höflichkeit/Möglichkeit")]),
    ("Es lebe der König!", [("lebe", "Konjunktiv I", "Wunsch/Optativ")]),
    ("Er hätte das gesagt.", [("hätte", "Konjunktiv II (Perfekt)", "Vergangenheitshypothese")]),
    ("Er hätte ein Haus.", [("hätte", "Konjunktiv II", "Irrealis/Hypothese")]),
    ("Die Frau kam, damit er gehe.", [("gehe", "Konjunktiv I", "Nebensatz")]),
    ("Es sei denn, er kommt.", []),
    ("Ich sage das nicht.", []),
    ("Ich habe das Buch gelesen.", []),
]


def test_genitives_and_subjunctives(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(GENITIVES + SUBJUNCTIVES)] + [(100, None), (101, ""), (102, "...")], "doc_id long, text string")
    got = M.governed(docs).orderBy("doc_id", "t_start").collect()
    for k, (text, want) in enumerate(GENITIVES):
        assert [(r.term, r.kind) for r in got if r.doc_id == k and r.rule == "genitiv"] == want, text
    for k, (text, want) in enumerate(SUBJUNCTIVES, len(GENITIVES)):
        assert [(r.term, r.kind, r.function) for r in got if r.doc_id == k and r.rule == "konjunktiv"] == want, text
    assert max(r.doc_id for r in got) < 100


def test_counts_of_a_corpus(spark):
    """Pairs counted by all tasks are those of each sentence; transitions of the corpus fit it no worse."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["der", "Hund", "geht", "schnell", "und", "die", "Katze", "schläft", "nicht"]) for _ in range(rng.randrange(1, 9))) + "." for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts = M.counted(docs)
    hand = M.first_counts().copy()
    for t in texts:
        tag, _ = M.analysed(batch([t]), M.costs(M.first_counts()))
        for a, b in zip([len(M.TAGS), *tag[:-1]], tag, strict=True):
            hand[a, b] += 1
    assert (counts == hand).all()
    per = lambda c: (hand - M.first_counts()).ravel() @ M.costs(c).ravel()
    assert per(counts) < per(M.first_counts())
    assert {r.tag for r in M.analyses(docs, counts).collect()} <= set(M.TAGS)


def test_only_sentences_that_may_have_the_tags_are_decoded(monkeypatch):
    seen = []
    monkeypatch.setattr(M, "decoded", lambda tag, cost, sizes, between, real=M.decoded: (seen.append(sizes.tolist()), real(tag, cost, sizes, between))[1])
    s = Scanned(pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["Ich gehe heim. Das Dach des Hauses ist rot. Wir lesen gern."], pa.string())], names=["doc_id", "text"]))
    between = M.costs(M.first_counts())
    all_of = M.Analysed(s, between)
    some = M.Analysed(s, between, np.array([M.TAGS.index("D.gen")]))
    assert seen == [[4, 7, 4], [7]]
    assert some.tag[4:11].tolist() == all_of.tag[4:11].tolist() and some.lemmas(4, 11) == all_of.lemmas(4, 11) and set(some.tag[:4]) == {-1}


def test_letters_without_case(spark):
    docs = spark.createDataFrame([(1, "Das Dach des Hauses in 日本 und ªa.")], "doc_id long, text string")
    assert [(r.term, r.rule) for r in M.governed(docs).collect()] == [("des Hauses", "genitiv")]
    assert M.analyses(docs).where("text = '日本'").first().tag == "E"
