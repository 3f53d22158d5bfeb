"""Sentences and tokens of documents.

One pass over the texts gives each sentence with its tokens as an array, in Arrow
batches; both tables are projections of it, so no shuffle is needed. (Offsets summed up
in SQL array functions took twenty times as long.) Sentence numbers start at 1,
offsets at 0, counted in code points; ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from ..sources.folders import through_folder

SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"
_SENTENCE = re.compile(SENTENCE)
#: Tokens are words (letters, single hyphens between them), runs of digits and single signs.
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_WORD = regex.compile(r"\p{L}+(?:-\p{L}+)*")
#: Text bytes taken at once, and rows.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 100_000

_TOKEN_TYPE = pa.struct(
    [(n, pa.int32()) for n in ("i", "t_start", "t_end")] + [(n, pa.string()) for n in ("text", "lower", "kind")] + [("n_syll", pa.int32())] + [(n, pa.string()) for n in ("prev1", "next1", "next2")]
)
_SENTENCE_TYPE = pa.schema([("doc_id", pa.int64()), ("sent_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("text", pa.string()), ("ts", pa.list_(_TOKEN_TYPE))])


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Blank, letter, digit or sign, for each code point."""
    kinds = np.full(0x110000, _SIGN, np.uint8)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        kinds[m.start() : m.end()] = _LETTER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[[ord(c) for c in " \t\n\r\f\x0B"]] = _BLANK
    return kinds


def _syllables(lower: pa.Array, words: np.ndarray) -> np.ndarray:
    n = np.maximum(1, pc.count_substring_regex(lower, "[aeiouäöü]+").to_numpy())
    for k in np.flatnonzero(pc.match_substring(lower, "-").to_numpy(zero_copy_only=False) & words):
        n[k] = sum(max(1, len(re.findall("[aeiouäöü]+", part))) for part in lower[k].as_py().split("-"))
    return n * words


class Scanned:
    """The sentences and tokens of a batch of texts. Words are told once: ``word`` numbers the batch's distinct tokens.

    doc_ids: of each row with tokens; row: place in the batch; doc: the row each sentence belongs to; numbers, begins, ends, sents: of
    the sentences; start, sentence: of the tokens; first: the first token of each sentence, and the number of all.
    """

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.texts = batch.column("text").to_pylist()
        # all texts one after the other, each with a line's end, told by code point
        whole = "".join(f"{text}\n" if text else "\n" for text in self.texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        own = np.fromiter((len(text) + 1 if text else 1 for text in self.texts), np.int64, len(self.texts))
        begin = np.cumsum(own) - own
        kinds = _kinds()[points]
        hyphen = np.flatnonzero(points == ord("-"))
        hyphen = hyphen[hyphen > 0]
        kinds[hyphen[(kinds[hyphen - 1] == _LETTER) & (kinds[hyphen + 1] == _LETTER)]] = _LETTER
        # a token or a blank begins where the kind changes, and at each sign
        new = np.ones(len(kinds), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _SIGN)
        piece = np.flatnonzero(new)
        token = kinds[piece] != _BLANK
        at = piece[token]
        # a sentence begins with its text and after marks
        mark = (points == ord(".")) | (points == ord("!")) | (points == ord("?"))
        new = np.zeros(len(kinds), bool)
        new[1:] = mark[:-1] & ~mark[1:]
        new[begin] = True
        bound = np.flatnonzero(new)
        row_of = np.searchsorted(begin, bound, side="right") - 1
        holds = (np.cumsum(new) - 1)[at]
        # sentences without a token are blank
        first = np.diff(holds, prepend=-1) != 0
        kept, self.sentence = holds[first], np.cumsum(first) - 1
        rows = row_of[kept]
        ends = np.minimum(np.append(bound[1:], len(kinds))[kept], (begin + own - 1)[rows])
        row, doc = np.unique(rows, return_inverse=True)
        self.row, self.doc = row.tolist(), doc.tolist()
        self.numbers = (kept - np.searchsorted(bound, begin)[rows] + 1).tolist()
        self.begins, self.ends = (bound[kept] - begin[rows]).tolist(), (ends - begin[rows]).tolist()
        self.sents = [whole[a:b] for a, b in zip(bound[kept].tolist(), ends.tolist(), strict=True)]
        self.doc_ids = batch.column("doc_id").take(pa.array(self.row, pa.int64()))
        self.start = at - begin[rows][self.sentence]
        self.first = np.searchsorted(self.sentence, np.arange(len(self.sents) + 1))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.append((np.cumsum(width) - width)[piece], width.sum()).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(piece), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode("utf-8", "surrogatepass"))])
        coded = pieces.filter(pa.array(token)).cast(pa.string()).dictionary_encode()
        self.word, self.text = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.lower = pc.utf8_lower(self.text)
        letters = pc.match_substring_regex(self.text, r"^\p{L}").to_numpy(zero_copy_only=False)
        digit = pc.match_substring_regex(self.text, "^[0-9]").to_numpy(zero_copy_only=False)
        self.kind = pa.array(np.array(["p", "d", "w"])[letters * 2 + digit], pa.string())
        self.n_syll = _syllables(self.lower, letters)
        self.length = pc.utf8_length(self.text).to_numpy()

    def of(self, tokens: np.ndarray) -> list[tuple[str, pa.DataType, pa.Array | np.ndarray]]:
        """doc_id and sent_no of some tokens, as columns for ``scanned``."""
        k = self.sentence[tokens]
        return [("doc_id", pa.int64(), self.doc_ids.take(pa.array(np.array(self.doc, np.int64)[k]))), ("sent_no", pa.int32(), np.array(self.numbers)[k])]

    def words(self) -> dict[str, pa.Array | np.ndarray]:
        """The distinct tokens, for predicates."""
        return {"text": self.text, "lower": self.lower, "kind": self.kind, "n_syll": self.n_syll}

    def beside(self, tokens: np.ndarray, k: int) -> pa.Array:
        """The k-th token after each of these, in lower case; null beyond the sentence."""
        there = tokens + k
        inside = (there >= 0) & (there < len(self.word))
        inside[inside] = self.sentence[there[inside]] == self.sentence[tokens[inside]]
        return self.lower.take(pa.array(np.where(inside, self.word[np.where(inside, there, 0)], 0), mask=~inside))

    def columns(self, tokens: np.ndarray) -> list[pa.Array]:
        """i, t_start, t_end, text, lower, kind, n_syll, prev1, next1, next2 of some tokens."""
        word, start = self.word[tokens], self.start[tokens]
        at = pa.array(word)
        numbers = [pa.array(x, pa.int32()) for x in (tokens - self.first[self.sentence[tokens]], start, start + self.length[word])]
        return [*numbers, self.text.take(at), self.lower.take(at), self.kind.take(at), pa.array(self.n_syll[word], pa.int32()), self.beside(tokens, -1), self.beside(tokens, 1), self.beside(tokens, 2)]


def _annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = Scanned(batch)
        if not s.sents:
            continue
        tokens = pa.StructArray.from_arrays(s.columns(np.arange(len(s.word))), fields=list(_TOKEN_TYPE))
        lists = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), tokens)
        made = [s.doc_ids.take(pa.array(s.doc)), s.numbers, s.begins, s.ends, s.sents, lists]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, _SENTENCE_TYPE, strict=True)], schema=_SENTENCE_TYPE)


_CUT_TYPE = pa.schema(list(_SENTENCE_TYPE)[:-1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for n, m in enumerate(_SENTENCE.finditer(text or ""), 1):
                if m[0].strip(" \t\n\r\f\x0B"):
                    for column, value in zip(rows, (doc_id, n, m.start(), m.end(), m[0]), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CUT_TYPE, strict=True)], schema=_CUT_TYPE)


def cut(text: str | None) -> list[str]:
    """The sentences of a text, blank ones too."""
    return _SENTENCE.findall(text or "")


def spark_type(schema: pa.Schema) -> StructType:
    return StructType.fromJson(from_arrow_type(pa.struct(list(schema))).jsonValue())


def batched(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` in batches of bounded size, dealt out to all cores."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # short texts: a batch's distinct words are judged once, so that small batches judge frequent words again and again
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    cores = 0 if docs.isStreaming else spark.sparkContext.defaultParallelism
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    # a small input in one file would keep one core busy
    return texts.repartition(cores) if cores and texts.rdd.getNumPartitions() < cores else texts


def token_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, start_char, end_char, text, ts (array of token structs) of each sentence that isn't blank."""
    return batched(docs).mapInArrow(_annotate, spark_type(_SENTENCE_TYPE))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, start_char, end_char, text. Blank sentences are left out but counted."""
    return batched(docs).mapInArrow(_cut, spark_type(_CUT_TYPE))


def distinct_words(docs: DataFrame) -> DataFrame:
    """lower, n, least, most: words of each batch of texts once, how often they stand there, and the smallest and largest doc_id (null: none) of the texts that have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[str] = []
            sizes = []
            for text in pc.utf8_lower(batch["text"]).to_pylist():
                own = _WORD.findall(text) if text else []
                words += own
                sizes.append(len(own))
            coded = pa.array(words, pa.string()).dictionary_encode()
            t = pa.table({"k": coded.indices, "id": batch["doc_id"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))})
            t = t.group_by("k").aggregate([([], "count_all"), ("id", "min"), ("id", "max")])
            made = [coded.dictionary.take(t["k"].combine_chunks()), t["count_all"].combine_chunks(), t["id_min"].combine_chunks(), t["id_max"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(made, names=["lower", "n", "least", "most"])

    return batched(docs).mapInArrow(count, "lower string, n bigint, least bigint, most bigint")


def word_counts(docs: DataFrame) -> DataFrame:
    """lower, n: how often each word stands in the texts."""
    return distinct_words(docs).groupBy("lower").agg(F.sum("n").alias("n"))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, alone in zip(batch["doc_id"].to_pylist(), pc.utf8_lower(batch["text"]).to_pylist(), batch["alone"].to_pylist(), strict=True):
            own = set(alone or ())
            for no, m in enumerate(_SENTENCE.finditer(text or ""), 1):
                if words := _WORD.findall(m[0]):
                    rows.append((doc_id, no, len(words), sum(w in own for w in words)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "sent_no", "n", "n_oov"])


def unshared_words(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, n, n_oov: words of each sentence, and those that no two documents have, told by doc_id.

    Such a word belongs to one document, so that document's texts meet the list of its words; no row is made for a word of a text.
    Rows without a doc_id have no list of their own: their words are looked up.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = through_folder(distinct_words(docs).groupBy("lower").agg(F.min("least").alias("least"), F.max("most").alias("most")), "words")
    alone = words.where("least = most").groupBy(F.col("least").alias("doc_id")).agg(F.collect_list("lower").alias("alone"))
    out = docs.where("doc_id IS NOT NULL").join(alone, "doc_id", "left").select("doc_id", "text", "alone").mapInArrow(_judged, "doc_id bigint, sent_no int, n bigint, n_oov bigint")
    nameless = docs.where("doc_id IS NULL")
    if not nameless.isEmpty():
        each = tokens(token_arrays(nameless)).where("kind = 'w'").groupBy("doc_id", "sent_no", "lower").agg(F.count(F.lit(1)).alias("n"))
        shared = words.where("least < most").select("lower", F.lit(0).alias("none"))
        out = out.unionByName(each.join(shared, "lower", "left").select("doc_id", "sent_no", "n", F.coalesce("none", "n").alias("n_oov")))
    return out.groupBy("doc_id", "sent_no").agg(F.sum("n").alias("n"), F.sum("n_oov").alias("n_oov"))


def scanned(docs: DataFrame, find: Callable[[Scanned], Sequence[tuple[str, pa.DataType, pa.Array | np.ndarray]]], schema: str) -> DataFrame:
    """What ``find`` makes of each batch of texts with tokens: columns, as arrays; only these leave the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Scanned(batch)
            if s.sents:
                made = find(s)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for _, kind, x in made], names=[name for name, _, _ in made])

    return batched(docs).mapInArrow(run, schema)


def tokens(arrays: DataFrame) -> DataFrame:
    """A row for each token: doc_id, sent_no, i (from 0 in its sentence), t_start, t_end, text, lower, kind (w, d, p), n_syll, prev1, next1, next2 (lower case)."""
    return arrays.select("doc_id", "sent_no", F.inline("ts"))


class Annotated:
    """A corpus with its sentences and tokens; each table is declared once and planned where it is used."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.select("doc_id", "text")
        self.arrays = token_arrays(self.docs)
        self.sentences = sentences(self.docs)
        self.tokens = tokens(self.arrays)


#: The same tables in DuckDB, as common table expressions s and t.
SENTENCES_SQL = r"""s AS (
  SELECT doc_id, sent_no, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_char, text
  FROM (SELECT doc_id, unnest(p) AS text, CAST(generate_subscripts(p, 1) AS INTEGER) AS sent_no FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*|[.!?]+') AS p FROM documents WHERE text IS NOT NULL))
), sent AS (SELECT doc_id, sent_no, start_char, CAST(start_char + length(text) AS INTEGER) AS end_char, text FROM s WHERE regexp_replace(text, '[ \t\n\r\f\x0B]', '', 'g') <> '')"""
TOKENS_SQL = (
    SENTENCES_SQL
    + r""", pieces AS (
  SELECT doc_id, sent_no, start_char, unnest(p) AS text, generate_subscripts(p, 1) AS k
  FROM (SELECT *, regexp_extract_all(text, '\p{L}+(?:-\p{L}+)*|[0-9]+|[ \t\n\r\f\x0B]+|[^\p{L}0-9 \t\n\r\f\x0B]') AS p FROM sent)
), placed AS (
  SELECT doc_id, sent_no, k, text, CAST(start_char + coalesce(sum(length(text)) OVER (PARTITION BY doc_id, sent_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM pieces
), tok AS (
  SELECT doc_id, sent_no, CAST(row_number() OVER w - 1 AS INTEGER) AS i, start AS t_start, CAST(start + length(text) AS INTEGER) AS t_end, text, lower(text) AS lower,
    CASE WHEN regexp_matches(text, '^\p{L}') THEN 'w' WHEN regexp_matches(text, '^[0-9]') THEN 'd' ELSE 'p' END AS kind,
    CASE WHEN regexp_matches(text, '^\p{L}') THEN CAST(list_sum(list_transform(string_split(lower(text), '-'), lambda p: greatest(1, len(regexp_extract_all(p, '[aeiouäöü]+'))))) AS INTEGER) ELSE 0 END AS n_syll,
    lag(lower(text)) OVER w AS prev1, lead(lower(text)) OVER w AS next1, lead(lower(text), 2) OVER w AS next2
  FROM placed WHERE NOT regexp_matches(text, '^[ \t\n\r\f\x0B]') WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY k)
)"""
)
