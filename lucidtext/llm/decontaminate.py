"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of all training words: each Arrow batch of
documents becomes one segment with a dictionary of its words and, word by word, the
ascending positions where it stands. Segments are partitioned by document, so
building needs no shuffle and no word is hot. ``search`` looks phrases up in every
segment: it begins with the postings of a phrase's rarest word, shifts them by the
word's offset, and intersects them with the shifted postings of the next rarest word
until none is left or all words agree. ``slop`` > 0 gives proximity matches: the
words in order of the phrase, each at most ``slop`` positions away from its place.

The phrases reach the segments as blocks of about ``block_bytes`` of benchmark text; a
larger benchmark takes more passes over the stored index instead of a larger broadcast.
A block is its words as numbers and the distinct phrases as places in them, so it is
sent in a few bytes a word; a segment translates the words into its own numbers at
once and looks only at phrases all of whose words it has.

Null and empty texts have no words and no hits; repeated rows are judged each on
their own; a benchmark without words hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._shared import bound_batches, columns, few, release, table, written

WINDOW = 13
#: Free positions between two documents of a segment: no phrase spans two.
GAP = 64
BLOCK_BYTES = 8 << 20
#: Text bytes of a segment: larger ones are searched for more documents at once.
SEGMENT_BYTES = 4 << 20
#: Postings, and words of phrases, looked at in one step, which bounds a search's memory.
STEP = 1_000_000

INDEX = "segment string, doc_ids binary, firsts binary, counts binary, dictionary binary, ends binary, postings binary"
MATCHES = "segment string, place int, doc_id long, n_words long, n_hit long, items array<string>, spans binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=kind)


def _segment(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    w = _words.words(batch.column("text"), _words.ALNUM, lower=True)
    ids, distinct = w.ids()
    n = w.counts()
    # a document's first position: all words before it, and a gap before each document
    firsts = w.first[:-1] + GAP * np.arange(1, w.n_docs + 1)
    keys = np.sort(ids << 32 | (np.arange(len(ids)) + GAP * (w.doc() + 1)))
    postings = (keys & 0xFFFFFFFF).astype(np.uint32)
    ends = np.cumsum(np.bincount(ids, minlength=len(distinct))).astype(np.uint32)
    gaps = np.diff(postings, prepend=np.uint32(0))  # wraps around where a word's postings begin
    doc_id = batch.column("doc_id")
    known = doc_id.is_valid().to_numpy(zero_copy_only=False)
    row = [name, _pack(np.concatenate([known.astype(np.int64), doc_id.fill_null(0).to_numpy()])), _pack(firsts), _pack(n), zstandard.compress(b"\0".join(distinct.to_pylist()), 1), _pack(ends), _pack(gaps.astype(np.uint32))]
    kinds = [pa.string()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each segment; ``docs`` has doc_id and text."""
    bound_batches(docs.sparkSession, SEGMENT_BYTES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if batch.num_rows:
                yield _segment(batch, f"{part:08d}-{k:06d}")
                release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX)


class Phrases:
    """Distinct windows of items: places in the items' words. Items: (item_id, text).

    words: the distinct words; stream: all words of the items as numbers of these; start, size: each phrase's place in
    the stream; names: the item_ids, sorted; owner[ends[i] : ends[i + 1]]: items (places in names) of phrase i.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        w = _words.words(pa.array([t for _, t in items], pa.string()), _words.ALNUM, lower=True)
        ids, self.words = w.ids()
        self.stream = ids.astype(np.int32)
        n = w.counts()
        many = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(items)), many)
        start = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(n[item], window)
        # equal phrases get one number, exactly: that of the words so far and of the next word, again and again
        number = size.astype(np.int64)
        for j in range(window):
            word = np.where(size > j, ids[np.minimum(start + j, max(len(ids) - 1, 0))] + 1, 0) if len(ids) else number * 0
            number = np.unique(number * (len(self.words) + 1) + word, return_inverse=True)[1]
        self.names, name = np.unique(np.array([x for x, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        pair = np.unique(np.stack([number, name[item]], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        _, first = np.unique(number, return_index=True)
        self.start, self.size, self.owner = start[first], size[first], pair[:, 1].astype(np.int32)
        self.ends = np.searchsorted(pair[:, 0], np.arange(len(first) + 1))

    def owners(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``phrase``, item) of all items that the phrases come from."""
        many = self.ends[phrase + 1] - self.ends[phrase]
        at = np.repeat(np.arange(len(phrase)), many)
        return at, self.owner[np.repeat(self.ends[phrase], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]


def _places(keys: np.ndarray, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all places of each row's word from ``low`` to ``high``."""
    first, last = np.searchsorted(keys, (term << 32) + np.maximum(low, 0)), np.searchsorted(keys, (term << 32) + np.maximum(high, -1), side="right")
    many = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(term)), many)
    return row, keys[np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] & 0xFFFFFFFF


def _occurrences(terms: np.ndarray, size: np.ndarray, keys: np.ndarray, ends: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of all matches. terms: the word numbers of each phrase in a row, -1 beyond its size.

    With ``slop``, a match begins with the phrase's first word; the others follow in their order, each at the next place where it
    stands, and up to ``slop`` other words lie between all of them.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    freq = np.where(terms >= 0, ends[terms].astype(np.int64) - begins[terms], np.iinfo(np.int64).max)
    order = np.argsort(freq, axis=1, kind="stable")  # offsets, the rarest word first
    rarest = np.take_along_axis(freq, order[:, :1], 1)[:, 0]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bounds = np.concatenate([[0], np.cumsum(rarest)])
    at = 0
    while at < len(terms):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP, side="right")) - 1)
        rows = np.arange(at, to)
        many = rarest[rows]
        phrase = np.repeat(rows, many)
        first = terms[rows, order[rows, 0]]
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
        start = (keys[np.repeat(begins[first], many) + inner] & 0xFFFFFFFF) - order[phrase, 0]
        if slop:  # the first word stands up to ``slop`` places before the one that the rarest word's place asks for
            row, start = _places(keys, terms[phrase, 0], start - slop, start)
            phrase, start = np.unique(np.stack([phrase[row], start]), axis=1)
            last = start.copy()
            for j in range(1, terms.shape[1]):
                need = size[phrase] > j
                word = terms[phrase, np.minimum(j, size[phrase] - 1)] << 32
                hit = np.searchsorted(keys, word + last + 1)
                place = keys[np.minimum(hit, len(keys) - 1)] - word
                ok = ~need | ((hit < len(keys)) & (place <= start + j + slop))
                last = np.where(need, place, last)
                phrase, start, last = phrase[ok], start[ok], last[ok]
            out.append((phrase, start, last + 1))
        else:
            for j in range(1, terms.shape[1]):
                need = size[phrase] > j
                off = order[phrase, np.minimum(j, size[phrase] - 1)]
                want = (terms[phrase, off] << 32) + start + off
                hit = np.searchsorted(keys, want)
                ok = ~need | ((hit < len(keys)) & (keys[np.minimum(hit, len(keys) - 1)] <= want))
                phrase, start = phrase[ok], start[ok]
                if not len(phrase):
                    break
            out.append((phrase, start, start + size[phrase]))
        at = to
    return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))


def _found(dictionary: bytes, phrases: Phrases, keys: np.ndarray, ends: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of all matches in a segment."""
    own = pa.array(dictionary.split(b"\0"), pa.large_binary())
    number = pc.fill_null(pc.index_in(phrases.words, value_set=own), -1).to_numpy()
    term = number[phrases.stream]
    missing = np.concatenate([[0], np.cumsum(term < 0)])
    alive = np.flatnonzero(missing[phrases.start + phrases.size] == missing[phrases.start])
    out = []
    for k in range(0, len(alive), max(1, STEP // WINDOW)):
        part = alive[k : k + max(1, STEP // WINDOW)]
        size = phrases.size[part]
        place = np.arange(size.max())
        at = np.minimum(phrases.start[part][:, None] + place, len(term) - 1)
        grid = np.where(place < size[:, None], term[at], -1).astype(np.int64)
        phrase, start, end = _occurrences(grid, size, keys, ends, slop)
        out.append((part[phrase], start, end))
    return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))


def _search_segment(row: dict, phrases: Phrases, slop: int, all_docs: bool) -> pa.RecordBatch:
    ids = _unpack(row["doc_ids"], np.int64)
    n_docs = len(ids) // 2
    firsts, counts = _unpack(row["firsts"], np.int64), _unpack(row["counts"], np.int64)
    ends = _unpack(row["ends"], np.uint32).astype(np.int64)
    keys = np.cumsum(_unpack(row["postings"], np.uint32), dtype=np.uint32).astype(np.int64)
    keys += np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) << 32
    n_hit, items, spans = np.zeros(n_docs, np.int64), [[] for _ in range(n_docs)], [b""] * n_docs
    phrase, start, last = _found(zstandard.decompress(row["dictionary"]), phrases, keys, ends, slop) if len(ends) and len(phrases.start) else (ids[:0], ids[:0], ids[:0])
    if slop:  # the next place of a word may lie in the next document
        own = last <= (firsts + counts)[np.searchsorted(firsts, start, side="right") - 1]
        phrase, start, last = phrase[own], start[own], last[own]
    if len(phrase):
        doc = np.searchsorted(firsts, start, side="right") - 1
        edge = np.zeros(int(firsts[-1] + counts[-1]) + 2, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, last, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        n_hit = total[firsts + counts] - total[firsts]
        pairs = np.unique(doc * len(phrases.start) + phrase)
        at, item = phrases.owners(pairs % len(phrases.start))
        of = np.unique((pairs // len(phrases.start))[at] * len(phrases.names) + item)
        by = of // len(phrases.names)
        named = phrases.names[of % len(phrases.names)]  # names are sorted, so each document's are
        hit = np.flatnonzero(n_hit)
        for d, lo, hi in zip(hit.tolist(), np.searchsorted(by, hit), np.searchsorted(by, hit, side="right"), strict=True):
            items[d] = named[lo:hi].tolist()
        order = np.lexsort([last, start])
        own = np.stack([start - firsts[doc], last - firsts[doc]], 1)[order].astype(np.int64)
        by = doc[order]
        for d, lo, hi in zip(hit.tolist(), np.searchsorted(by, hit), np.searchsorted(by, hit, side="right"), strict=True):
            spans[d] = np.unique(own[lo:hi], axis=0).tobytes()
    names = [x.split()[0] for x in MATCHES.split(", ")]
    made = [
        pa.array([row["segment"]] * n_docs, pa.string()),
        pa.array(np.arange(n_docs), pa.int32()),
        pa.array(ids[n_docs:], pa.int64(), mask=ids[:n_docs] == 0),
        pa.array(counts, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array(items, pa.list_(pa.string())),
        pa.array(spans, pa.binary()),
    ]
    out = pa.RecordBatch.from_arrays(made, names=names)
    return out if all_docs else out.filter(pa.array(n_hit > 0))


def _merged(parts: list[bytes]) -> tuple[int, bytes]:
    """Positions covered by the spans of several blocks, and all spans."""
    spans = np.unique(np.concatenate([np.frombuffer(p, np.int64) for p in parts]).reshape(-1, 2), axis=0)
    if not len(spans):
        return 0, b""
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.concatenate([[0], reach[:-1]])
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], before)).sum()), spans.tobytes()


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: n_words, n_hit, items (sorted) and spans (pairs of word positions, little-endian int64).

    ``benchmark`` has item_id and text; it is read in blocks of about ``block_bytes``.
    """
    if window > GAP // 2:
        raise ValueError(f"a window may be {GAP // 2} words at most")
    spark = index.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    found = None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        sent = spark.sparkContext.broadcast(Phrases([(r.item_id, r.text) for r in block.toLocalIterator()], window))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _search_segment(batch.slice(i, 1).to_pylist()[0], sent.value, slop, n_blocks == 1)
                    release()

        part = index.mapInArrow(look, MATCHES)
        if n_blocks == 1:
            return part
        part = written(part, "matches")  # of one block, only the documents that it hits
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    joined = F.udf(lambda parts: _merged([bytes(p) for p in parts]), "n_hit long, spans binary")
    hits = (
        found.groupBy("segment", "place")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("spans").alias("parts"))
        .withColumn("merged", joined("parts"))
        .select("segment", "place", "merged.n_hit", "items", "merged.spans")
    )
    none = F.array().cast("array<string>")
    every = index.mapInArrow(_counted, COUNTED).join(hits, ["segment", "place"], "left")
    return every.select("segment", "place", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.lit(b"")).alias("spans"))


COUNTED = "segment string, place int, doc_id long, n_words long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, place, doc_id, n_words of all documents of the index."""
    for batch in batches:
        for row in batch.select(["segment", "doc_ids", "counts"]).to_pylist():
            ids, counts = _unpack(row["doc_ids"], np.int64), _unpack(row["counts"], np.int64)
            n = len(counts)
            made = [pa.array([row["segment"]] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(ids[n:], pa.int64(), mask=ids[:n] == 0), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in COUNTED.split(", ")])


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row, repeated ones included, judged by its own text. Null and empty texts have no words; a null item_id counts as an empty one; without documents no rows."""
    index = written(build_index(table(spark, sf_dir, "documents")), "index")
    found = search(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contract's rule doesn't call contaminated; columns stay.

    A row goes by its own text: the index knows it by a hash of doc_id and text, so rows
    that share a doc_id, or have none, don't go with a contaminated one.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    index = written(build_index(docs.select(key.alias("doc_id"), "text")), "index")
    bad = few(written(search(index, table(spark, sf_dir, "benchmark")).where(contaminated()).select("doc_id").distinct(), "bad"), 1)
    row = docs.select(F.struct(*columns(docs)).alias("_row"))
    gone = F.xxhash64(F.col("_row.doc_id").cast("long"), F.col("_row.text")) == F.col("_bad")
    return row.join(bad.select(F.col("doc_id").alias("_bad")), gone, "left_anti").select("_row.*")


#: The same rows by word strings: windows of the items against windows of the documents.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)
), hits AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
