"""Quality rules with compression bands.

Base figures come from the words of the whole text. The method then compresses with
zstandard: the whole document, and fixed chunks of it. A ratio (raw bytes over
compressed bytes) above its band means repetition, below it noise; the band's limits
depend on the length compressed, as short texts compress less. A document is kept if
its own ratio lies in the band for its length and at most ``MAX_BAD_SHARE`` of its
chunks, the last and shorter one included, lie outside the bands for theirs. A text of
up to one chunk is that chunk.

Null, empty and word-free texts have no words and fail the base rule. The longest
text is compressed as a stream of its own; nothing is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import _words
from ._shared import bound_batches, table

LEVEL = 3
CHUNK = 4096
#: (bytes up to, lowest ratio, highest ratio); the last row holds for all longer texts.
BANDS = ((64, 0.0, 2.5), (256, 0.9, 2.5), (1024, 1.2, 3.0), (4096, 1.4, 4.5), (16384, 1.5, 6.0), (65536, 1.6, 7.5), (None, 1.6, 9.0))
MAX_BAD_SHARE = 0.5
MIN_WORDS = 50

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"
_TYPE = pa.struct([(n, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in FIGURES.split(", "))])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _band(n: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((lo, hi) for top, lo, hi in bands if top is None or n <= top)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring bounds."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, bounds))


def _repeats(w: _words.Words) -> np.ndarray:
    """Words of each text that stand in a 3-word window found at least twice in the text."""
    ids, distinct = w.ids()
    n = w.counts()
    if len(ids) < 3:
        return np.zeros(w.n_docs, np.int64)
    doc = w.doc()
    at = np.flatnonzero(doc[:-2] == doc[2:])
    # exact numbers: pairs get a number first, then (pair, word), then with the text
    _, pair = np.unique(ids[at] * len(distinct) + ids[at + 1], return_inverse=True)
    _, triple = np.unique(pair * len(distinct) + ids[at + 2], return_inverse=True)
    key = doc[at] * (int(triple.max()) + 1 if len(triple) else 1) + triple
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(ids) + 2, bool)
    for j in range(3):
        hit[at[twice] + j] = True
    return _sums(hit[: len(ids)], np.concatenate([[0], np.cumsum(n)]))


def _duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line.strip(b" \t\n\v\f\r"):
            again += line in seen
            seen.add(line)
    return again


def figures(texts: pa.Array) -> pa.Array:
    w = _words.words(texts, _words.NOT_SPACE, lower=False)
    n = w.counts()
    raw = np.frombuffer(w.data, np.uint8)
    # code points in words: bytes that begin a character and aren't white space
    chars = _sums(_words.NOT_SPACE[raw] & ((raw & 0xC0) != 0x80), w.text_start)
    symbols = _sums(_SYMBOL[raw], w.text_start)
    repeats = _repeats(w)
    failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
    press = zstandard.ZstdCompressor(level=LEVEL)
    dups, ratios, chunks, bad, kept = [], [], [], [], []
    for i in range(w.n_docs):
        text = w.data[w.text_start[i] : w.text_start[i + 1]]
        dups.append(_duplicate_lines(text))
        ratio = len(text) / len(press.compress(text)) if text else 0.0
        cut = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
        pieces = [(len(x), len(x) / len(press.compress(x)) if len(cut) > 1 else ratio) for x in cut]
        odd = sum(not lo <= x <= hi for n_bytes, x in pieces for lo, hi in [_band(n_bytes)])
        ratios.append(ratio)
        chunks.append(len(pieces))
        bad.append(odd)
        lo, hi = _band(len(text))
        kept.append(bool(not failed[i] and lo <= ratio <= hi and odd <= MAX_BAD_SHARE * len(pieces)))
    columns = [n, chars, symbols, dups, repeats, failed, ratios, chunks, bad, kept]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPE, strict=True)], fields=list(_TYPE))


@F.arrow_udf(from_arrow_type(_TYPE))
def quality_figures(texts: pa.Array) -> pa.Array:
    return figures(texts)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row. Null and empty texts have no words and fail; repeated rows get the same result; without documents no rows."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality_figures("text").alias("q")).select("doc_id", "q.*")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; columns stay. Null, empty and word-free texts go; repeated rows go or stay together."""
    bound_batches(spark)
    return docs.where(quality_figures("text").getField("kept"))
