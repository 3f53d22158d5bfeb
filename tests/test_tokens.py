"""What leaves a batch of texts: words, pairs and runs that are asked for, not a row for each token."""

import random
import re

import pytest
import regex

from lucidtext.operators import annotate
from lucidtext.plans import companions, corpus, rules, service
from lucidtext.sources import sinks

TEXTS = [
    (1, "Der Hund was gelaufen. Ein Hund is, ja, wird gefragt und wird genannt! (ABK) abk Abk."),
    (2, "Das Rote Haus An Der Straße. Die Katze was\nmüde... Freund-Schaft Landschaft, Freundschaft. (ABK)"),
    (2, "Hund abk (Xy-1) xy-1 xy. Landschaft"),
    (None, "Hund Nirgends Katze nie gesehen. (Zz) zz"),
    (3, ""),
    (4, None),
    (5, "Eine Katze Nirgends einzig allein. 12 Hund"),
]


@pytest.fixture()
def at(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def words(text):
    return [w.lower() for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text or "")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def no_tokens(monkeypatch):
    """A row for each token is what took memory and time."""

    def fail(*_):
        raise AssertionError("all tokens become rows")

    monkeypatch.setattr(annotate, "token_arrays", fail)


def test_word_counts(spark, at, monkeypatch):
    no_tokens(monkeypatch)
    want = {}
    for _, t in TEXTS:
        for w in words(t):
            want[w] = want.get(w, 0) + 1
    assert dict(rows(annotate.word_counts(spark.read.parquet(f"{at}/documents.parquet")))) == want
    assert rows(companions.aux11(spark, at)) == [("freund-schaft", "freund-", "schaft"), ("freundschaft", "freund", "schaft"), ("landschaft", "land", "schaft")]
    assert corpus.jn6(spark, at).count() == 0


def test_pairs_and_runs(spark, at, monkeypatch):
    no_tokens(monkeypatch)
    text = dict((k, t) for k, t in TEXTS if k != 2)[1]
    want = []
    for no, m in enumerate(re.finditer(r"[^.!?]+[.!?]*|[.!?]+", text), 1):
        ts = [x.lower() for x in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*|[0-9]+|[^\w \n]", m[0])]
        want += [(1, no, i, i + k) for i, x in enumerate(ts) if x in ("was", "is", "wird", "est", "es") for k in (1, 2, 3) if i + k < len(ts) and re.search("(ed|nd|t)$", ts[i + k])]
    assert want and [r for r in rows(corpus.jn8(spark, at)) if r[0] == 1] == sorted(want, key=repr)
    runs = [r for r in rows(corpus.jn12(spark, at)) if r[0] == 2]
    assert (2, 1, 0, 27, 0, 6) in runs and all(r[0] is not None for r in rows(corpus.jn12(spark, at)))


def test_unshared_words(spark, at):
    docs = {}
    for k, t in TEXTS:
        for w in words(t):
            docs.setdefault(w, set()).update({k} - {None})
    want = {}
    for k, t in TEXTS:
        for no, m in enumerate(re.finditer(r"[^.!?]+[.!?]*|[.!?]+", t or ""), 1):
            own = words(m[0])
            if own:
                n, oov = want.get((k, no), (0, 0))
                want[k, no] = n + len(own), oov + sum(len(docs[w]) < 2 for w in own)
    got = {(r.doc_id, r.sent_no): (r.n, r.n_oov) for r in annotate.unshared_words(spark.read.parquet(f"{at}/documents.parquet")).collect()}
    assert got == want
    assert rules.agg16(spark, at).count() == sum(n >= 3 and 100 * o >= 15 * n for n, o in want.values())


def test_few_texts_are_cut(spark, at, monkeypatch):
    seen = []
    monkeypatch.setattr(service, "Annotated", lambda docs, real=service.Annotated: (seen.append(docs), real(docs))[1])
    assert rows(service.prj20(spark, at)) == sorted([(1, "abk", 3), (2, "abk", 2), (2, "xy-1", 0), (None, "zz", 0)], key=repr)
    assert seen[0].select("doc_id").distinct().count() == 2
    monkeypatch.setattr(service, "SENT_ROWS", 0)
    assert service.prj20(spark, at).count() == 4


def test_grams_are_counted_in_batches(spark, at, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.training, "lm_tokens", None)
    sinks.ngram_tables(spark.read.parquet(f"{at}/documents.parquet"), f"{tmp_path}/grams", order=2)
    got = dict(rows(spark.read.parquet(f"{tmp_path}/grams/n=1").select("gram", "n")))
    assert got["hund"] == 5 and got["."] == sum((t or "").count(".") for _, t in TEXTS) and "<s>" not in got
    pairs = dict(rows(spark.read.parquet(f"{tmp_path}/grams/n=2").select("gram", "n")))
    assert pairs["<s> hund"] == 2 and pairs["<s> </s>"] == 1


def test_a_batch_is_cut_at_once(monkeypatch):
    """No object for each token of a text: kinds of code points tell where tokens and sentences begin."""
    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choice("abÄß--.!? \n\t\x0b\x1c12٣ǅªʰ日🙂é’'İ") for _ in range(rng.randrange(50))) for _ in range(2000)] + [None, "", " ", "...", "-a-b--c-", "a"]
    assert not hasattr(annotate, "_TOKEN")
    s = annotate.Scanned(pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]))
    got = [(s.row[s.doc[k]], s.numbers[k], a, s.text[w].as_py()) for k, a, w in zip(s.sentence.tolist(), s.start.tolist(), s.word.tolist(), strict=True)]
    want, sents = [], []
    for row, text in enumerate(texts):
        for no, m in enumerate(re.finditer(r"[^.!?]+[.!?]*|[.!?]+", text or ""), 1):
            own = [(row, no, m.start() + x.start(), x[0]) for x in regex.finditer(r"\p{L}+(?:-\p{L}+)*|[0-9]+|[^\p{L}0-9 \t\n\r\f\x0B]", m[0])]
            sents += [(m.start(), m.end(), m[0])] if own else []
            want += own
    assert got == want and list(zip(s.begins, s.ends, s.sents, strict=True)) == sents
