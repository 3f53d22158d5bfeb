"""The pipeline's stages on small tables, each against brute force on its own input."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import PLAIN, brute_classes, brute_hits, water

import corpus_pipeline
from lucidtext.llm import quality, tokens
from lucidtext.llm._shared import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input of each stage, and the last one's result; columns that operators use inside come along."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"h": F.col("n_chars"), "node": F.lit("x"), "copies": F.lit(9), "_row": F.lit(None).cast("string")})
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (5, None, None, "src1", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    docs = docs.unionByName(docs.limit(20))
    out = [written(docs, "start")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), name))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_quality(stages):
    given = rows(stages[0])
    kept = quality.figures(pa.array([t for _, t, _ in given], pa.string())).field("kept").to_pylist()
    assert Counter(rows(stages[1])) == Counter(r for r, k in zip(given, kept, strict=True) if k)


def test_near_duplicates(stages):
    given = rows(stages[1])
    _, classes = brute_classes(given, 5, 80)
    least = {}
    for r, c in zip(given, classes, strict=True):
        least[c] = min(least.get(c, 1 << 62), r[0])
    assert sorted(r[0] for r in rows(stages[2])) == sorted(least.values())


def test_decontamination(spark, stages):
    given = rows(stages[2])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [r for r, (n, hit, _) in zip(given, brute_hits([t for _, t, _ in given], bench), strict=True) if not (hit and 20 * hit >= n)]
    assert Counter(rows(stages[3])) == Counter(clean) and len(clean) < len(given)


def test_mix(stages):
    size = lambda r: len(PLAIN.findall(r[1] or ""))
    given, got = rows(stages[3]), Counter(rows(stages[4]))
    total, taken = Counter(), Counter()
    for r in given:
        total[r[2]] += size(r)
    for r, n in got.items():
        assert r in given and n <= 3
        taken[r[2]] += n * size(r)
    for s, t in water(total).items():
        assert abs(taken[s] - t) <= max(size(r) for r in given if r[2] == s)


def test_tokens(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = Counter()
    for doc_id, text, _ in rows(stages[4]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids)] += 1
    got = stages[5].orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "empty")
        assert docs.count() == 0
