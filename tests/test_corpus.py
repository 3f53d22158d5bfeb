"""Queries over small tables made for them."""

import numpy as np

from lucidtext.plans import corpus


def test_cosines_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    v = {i: (base * (i % 3 > 0) + rng.normal(size=8) * rng.uniform(0.1, 2)).astype(np.float32) for i in range(0, 500, 10)}
    v[7] = np.zeros(8, np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in v.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for q in (i for i in v if i % 100 == 0):
        for i, x in v.items():
            a, b = v[q].astype(float), x.astype(float)
            if i not in (q, 7) and (c := a @ b / np.linalg.norm(a) / np.linalg.norm(b)) >= 0.65:
                want.add((q, i, bool(c >= 0.75), bool(c >= 0.85)))
    assert {tuple(r) for r in corpus.jn13_pairs(spark, str(tmp_path)).collect()} == want and len({w[2:] for w in want}) == 3


def test_levenshtein_by_code_point(spark):
    from lucidtext.plans import queries

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    data = "/root/testdata/sf0.001"
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {r.item_id: r.d for r in queries.queries()["scalar_levenshtein"](spark, data).collect()}
    assert got == {i: distance(t, texts[i + 1]) for i, t in texts.items() if i + 1 in texts}


def test_acceptable_rewrites_by_hand(spark):
    import difflib

    from lucidtext.plans import fixtures, queries

    rows = {r[0]: r for r in fixtures.PAIRS.rows}
    names = [x.split()[0] for x in fixtures.PAIRS.schema.split(", ")]
    lazy = {r.id: r.lazy for r in queries.queries()["prj16_lazy_rewrites"](spark, "").collect()}
    for r in queries.queries()["prj17_acceptable"](spark, "").collect():
        row = dict(zip(names, rows[r.id], strict=True))
        a, b = row["candidate"], row["source"]
        ratio = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert r.similarity == ratio and r.acceptable == (not lazy[r.id] and ratio >= 0.15)


def test_sentences_are_rewritten(spark):
    from lucidtext.operators import rewriting

    docs = spark.createDataFrame([(1, "Die Administration hilft!! Das Haus ist rot."), (2, "Wir gehen, und sie gehen, und alle Leute gehen heute zusammen nach Hause."), (3, None), (4, " ")], "doc_id long, text string")
    got = {(r.doc_id, r.idx): r for r in rewriting.refined(docs).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert got[1, 1].current == "Die Verwaltung hilft!" and got[1, 1].weighted < got[1, 1].before
    assert got[1, 2].current == got[1, 2].original and got[1, 2].status == "done" and got[1, 2].attempts == 0
    assert got[2, 1].weighted < got[2, 1].before and got[2, 1].current.count(".") > 1
    text = {r.doc_id: r for r in rewriting.rewritten(docs).collect()}
    assert text[1].text == "Die Verwaltung hilft! Das Haus ist rot." and text[1].edits == 1


def test_rewriting_keeps_rows_of_one_id_apart(spark):
    from lucidtext.operators import rewriting

    texts = [(1, "Die Administration hilft!! Das Haus ist rot."), (1, "Das Haus ist rot."), (1, "Die Administration hilft!!"), (None, "Die Administration hilft!! Das Haus ist rot."), (None, "Das Haus ist rot."), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = "Die Verwaltung hilft!"
    got = [(r.doc_id, r.idx, r.current) for r in rewriting.refined(docs).collect()]
    want = [(1, 1, one), (1, 2, "Das Haus ist rot."), (1, 1, "Das Haus ist rot."), (1, 1, one), (None, 1, one), (None, 2, "Das Haus ist rot."), (None, 1, "Das Haus ist rot.")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    whole = [(r.doc_id, r.text, r.edits) for r in rewriting.rewritten(docs).collect()]
    assert sorted(map(repr, whole)) == sorted(map(repr, [(1, f"{one} Das Haus ist rot.", 1), (1, "Das Haus ist rot.", 0), (1, one, 1), (None, f"{one} Das Haus ist rot.", 1), (None, "Das Haus ist rot.", 0)]))
