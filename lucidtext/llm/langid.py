"""Language of web pages by Bayesian evidence fusion.

Text evidence is a multinomial model over hashed character trigrams, counted over all
labelled documents. Three more kinds of evidence join it: the language that the html
tag declares, the last label of the host (address suffix), and a prior of the host.
Likelihoods of declarations and suffixes come from counting them against the text
posteriors of all pages; the host's prior is smoothed towards its domain's, which is
smoothed towards that of all pages. A page's own text is taken out of its host's and
domain's counts, so that it isn't heard twice.

All counts are grouped aggregations, so a host with a third of all pages stays one
row for each task before the shuffle, and pages meet their sums without a task for a
host (``_shared.looked_up``). The model sent to executors has ``2**HASH_BITS`` numbers
a language, whatever the corpus size.

Null or empty html has no text evidence: the other kinds decide. A null url has no
host and no suffix; a missing declaration is evidence of its own kind. Rows that
repeat are counted each and get the same result. Without any labelled document there
is no language to choose, and ``lang`` is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import _words
from ._shared import bound_batches, looked_up, table, written
from .urls import host

HASH_BITS = 15
#: Text bytes counted at once: trigrams take many times as much.
BATCH_BYTES = 2 << 20
#: Numbers that a worker counts in at once; with more languages, each batch's counts go out by themselves.
DENSE_CELLS = 1 << 23
#: Text log-likelihoods are damped: trigrams of one text are far from independent.
DAMP = 0.2
ALPHA = 0.1
#: Pages that the wider prior counts for.
KAPPA = 5.0

_DROP = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)")


def visible(html: str | None) -> str:
    """The text that a page shows."""
    return unescape(_TAG.sub(" ", _DROP.sub(" ", html))) if html else ""


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed trigram) of all byte trigrams, white space, digits and ASCII punctuation counting as one blank."""
    data, at = _words.text_bytes(texts)
    raw = np.frombuffer(data.translate(_LETTERS), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = (doc[:-2] == doc[2:]) & ~((raw[:-2] == 32) & (raw[1:-1] == 32)) & ~((raw[1:-1] == 32) & (raw[2:] == 32))
    return doc[:-2][inside], (h >> np.uint32(32 - HASH_BITS))[inside].astype(np.int64)


_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """Trigram counts by language over all labelled documents: a matrix of fixed size."""
    place = {x: i for i, x in enumerate(langs)}

    def sums_of(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(langs) << HASH_BITS
        total = np.zeros(size if size <= DENSE_CELLS else 0, np.int64)
        for batch in batches:
            lang = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            doc, gram = _trigrams(batch.column("text"))
            known = lang[doc] >= 0
            cell = lang[doc[known]] << HASH_BITS | gram[known]
            if len(total):
                total += np.bincount(cell, minlength=size)
            else:
                yield sums_of(*np.unique(cell, return_counts=True))
        yield sums_of(at := np.flatnonzero(total), total[at])

    sums = docs.select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((len(langs), 1 << HASH_BITS), np.float32)
    got = sums.toArrow()  # at most a row for each cell
    out.ravel()[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


_FEATURES = pa.struct([("declared", pa.string()), ("scores", pa.list_(pa.float64())), ("post", pa.list_(pa.float64()))])
_FUSED = pa.struct([("lang", pa.string()), ("probability", pa.float64()), ("text_lang", pa.string())])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(model: np.ndarray):
    """A column function: html -> declared language, text log-likelihoods, text posterior (all 0 without text)."""

    @F.arrow_udf(from_arrow_type(_FEATURES))
    def features(html: pa.Array) -> pa.Array:
        pages = html.to_pylist()
        declared = [m[1].lower() if p and (m := _DECLARED.search(p)) else "" for p in pages]
        doc, gram = _trigrams(pa.array([visible(p) for p in pages], pa.string()))
        scores = np.stack([np.bincount(doc, weights=row[gram], minlength=len(pages)) for row in model], 1)
        post = softmax(scores) * (np.bincount(doc, minlength=len(pages)) > 0)[:, None]
        return pa.StructArray.from_arrays([pa.array(declared, pa.string()), pa.array(list(scores), pa.list_(pa.float64())), pa.array(list(post), pa.list_(pa.float64()))], fields=list(_FEATURES))

    return features


def _fusion(langs: list[str], world: np.ndarray):
    """A column function: text evidence and the sums around a page -> its language. ``world``: sum of all text posteriors."""
    n = len(langs)

    def rows(a: pa.Array) -> np.ndarray:
        return a.flatten().to_numpy().reshape(-1, n)

    def smoothed(counts: np.ndarray, wider: np.ndarray) -> np.ndarray:
        return (counts + KAPPA * wider) / (counts.sum(axis=1, keepdims=True) + KAPPA)

    @F.arrow_udf(from_arrow_type(_FUSED))
    def fused(scores: pa.Array, post: pa.Array, of_host: pa.Array, of_domain: pa.Array, of_declared: pa.Array, of_suffix: pa.Array) -> pa.Array:
        own, said = rows(post), rows(scores)
        host, domain, declared, suffix = (np.maximum(rows(x) - own, 0) for x in (of_host, of_domain, of_declared, of_suffix))
        prior = smoothed(host, smoothed(domain, (world + 1) / (world.sum() + n)))
        others = np.maximum(world - own, 0) + 1
        total = softmax(said + np.log(prior) + np.log((declared + 0.5) / others) + np.log((suffix + 0.5) / others))
        names = np.array(langs, object)
        text = names[said.argmax(axis=1)]
        text[own.sum(axis=1) == 0] = None
        columns = [pa.array(names[total.argmax(axis=1)], pa.string()), pa.array(total.max(axis=1)), pa.array(text, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(_FUSED))

    return fused


def suffix_of(labels: Column) -> Column:
    """The last label of a host: its address suffix."""
    return F.element_at(labels, -1)


def _sums(frame: DataFrame, key: str, n: int) -> DataFrame:
    """Sum of the text posteriors for each key: a row of ``n`` numbers."""
    return frame.groupBy(key).agg(F.array(*(F.sum(F.col("post")[i]) for i in range(n))).alias(f"of_{key}"), F.count(F.lit(1)).alias(f"{key}_pages"))


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix, host of each row of ``pages`` (page_id, url, html); ``docs`` has lang and text."""
    spark = pages.sparkSession
    bound_batches(spark, BATCH_BYTES)
    langs = sorted(r.lang for r in docs.select("lang").where("lang IS NOT NULL").distinct().toLocalIterator())
    h = host(F.col("url"))
    labels = F.split(F.regexp_replace(h, ":[0-9]*$", ""), r"\.")
    suffix = suffix_of(labels).alias("suffix")
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), suffix, h.alias("host"))
    n = len(langs)
    counts = counted(docs, langs) + ALPHA
    model = DAMP * np.log(counts / counts.sum(axis=1, keepdims=True))
    # co.uk and its like are suffixes of two labels
    three = (F.size(labels) >= 3) & (F.length(suffix_of(labels)) == 2) & F.element_at(labels, -2).isin("co", "com", "org", "net", "gov", "edu", "ac")
    domain = F.when(three, F.concat_ws(".", F.slice(labels, -3, 3))).when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(h).alias("domain")
    f = written(pages.select("page_id", h.alias("host"), domain, suffix, _features(model)("html").alias("f")).select("page_id", "host", "domain", "suffix", "f.*"), "features")
    world = np.array([x or 0.0 for x in f.agg(*(F.sum(F.col("post")[i]) for i in range(n))).first()])
    joined = f
    for key in ("host", "domain", "declared", "suffix"):
        joined = looked_up(joined, written(_sums(f, key, n), key), key, f"{key}_pages", n + 4)
    fused = _fusion(langs, world)("scores", "post", "of_host", "of_domain", "of_declared", "of_suffix")
    return joined.withColumn("r", fused).select("page_id", "r.*", "declared", "suffix", "host")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page row. Null html and null urls leave the other kinds of evidence to decide; of languages with equal posteriors the first in order; repeated rows get the same result; without pages no rows."""
    return identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
