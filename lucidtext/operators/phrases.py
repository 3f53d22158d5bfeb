"""Phrases of a lexicon in texts, one pass over the texts for a lexicon of any size.

``Contained`` finds phrases as they are, characters of a text that are those of a
phrase, with an Aho-Corasick automaton: the cost is that of the text and of what is
found. ``Windows`` finds windows of as many words as a phrase that agree with it, word
by word, in a given share: a window that agrees must hold one of a phrase's anchors at
its place (with m words that may differ, any m + 1 places), so only words that are
anchors of some phrase start a comparison. A placeholder ("jemandem") agrees with any word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import Scanned, batched

RATIO = 0.8
#: Phrases that are looked for at once.
BLOCK = 200_000


def needed(size: int, ratio: float = RATIO) -> int:
    """How many of ``size`` words must agree."""
    return math.ceil(ratio * size - 1e-9)


class Contained:
    """Phrases found in texts, overlapping ones too."""

    def __init__(self, phrases: Sequence[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            if p:
                self.automaton.add_word(p, (k, len(p)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(phrase, start, end) of each place."""
        if len(self.automaton):
            for last, (k, size) in self.automaton.iter(text):
                yield k, last + 1 - size, last + 1


class Windows:
    """Phrases, each a sequence of words, that windows agree with."""

    def __init__(self, phrases: Sequence[Sequence[str]], ratio: float = RATIO, wild: Sequence[str] = ()) -> None:
        free = set(wild)
        often = Counter(w for p in phrases for w in p)
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.need = np.array([needed(len(p), ratio) for p in phrases], np.int64)
        self.words = pa.array(sorted({w for p in phrases for w in p if w not in free}), pa.string())
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        #: of each place of each phrase: the word's number, or -1 for one that any word agrees with
        self.flat = np.array([number.get(w, -1) for p in phrases for w in p], np.int64)
        anchors = []
        for k, p in enumerate(phrases):
            fixed = [j for j, w in enumerate(p) if w not in free]
            # the rarest words of the lexicon, and of these the longest
            fixed.sort(key=lambda j, p=p: (often[p[j]], -len(p[j]), j))
            anchors += [(number[p[j]], k, j) for j in fixed[: len(p) - int(self.need[k]) + 1]]
        anchors.sort()
        of, self.phrase, self.place = (np.array(x, np.int64) for x in zip(*anchors, strict=True)) if anchors else (np.zeros(0, np.int64),) * 3
        self.first = np.searchsorted(of, np.arange(len(number) + 1))

    def __call__(self, distinct: pa.Array, word: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrase, first token and words that agree, of all windows that agree enough. ``word``: a number in ``distinct`` for each token, by sentences."""
        none = np.zeros(0, np.int64)
        if not len(word) or not len(self.phrase):
            return none, none, none
        known = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().astype(np.int64)[word]
        many = np.diff(self.first)
        at = np.flatnonzero(known >= 0)
        at = at[many[known[at]] > 0]
        each = many[known[at]]
        row = np.repeat(self.first[known[at]] - np.cumsum(each) + each, each) + np.arange(each.sum())
        start, phrase = np.repeat(at, each) - self.place[row], self.phrase[row]
        end = start + self.size[phrase] - 1
        inside = (start >= 0) & (end < len(word))
        inside[inside] = sentence[start[inside]] == sentence[end[inside]]
        pairs = np.unique(np.stack([start[inside], phrase[inside]], 1), axis=0)
        start, phrase = pairs[:, 0], pairs[:, 1]
        size = self.size[phrase]
        ends = np.cumsum(size)
        step = np.arange(size.sum()) - np.repeat(ends - size, size)
        want = self.flat[np.repeat(self.begin[phrase], size) + step]
        hit = (want < 0) | (want == known[np.repeat(start, size) + step])
        hits = np.add.reduceat(hit.astype(np.int64), ends - size) if len(size) else none
        good = hits >= self.need[phrase]
        return phrase[good], start[good], hits[good]


def words_only(s: Scanned) -> np.ndarray:
    """The tokens of a batch that are words or numbers."""
    return np.flatnonzero(pc.not_equal(s.kind, "p").to_numpy(zero_copy_only=False)[s.word])


def _blocks(lexicon: DataFrame, columns: list[str]) -> Iterator[list]:
    """Rows of a lexicon, in blocks of about ``BLOCK``."""
    n = max(1, -(-lexicon.count() // BLOCK))
    for k in range(n):
        yield lexicon.where(F.pmod(F.xxhash64(*columns), F.lit(n)) == k).collect() if n > 1 else lexicon.collect()


def contained(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, phrase_id, n, first_start: phrases of ``lexicon`` (phrase_id, phrase in lower case) in the lower-cased texts of ``docs``, at any character. Null and empty phrases are nowhere; each row of ``docs`` is judged on its own."""
    found = None
    for rows in _blocks(lexicon.where("phrase <> ''").select("phrase_id", "phrase"), ["phrase_id", "phrase"]):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lexicon = Contained([r.phrase for r in sent.value])
            ids = pa.array([r.phrase_id for r in sent.value], pa.int64())
            for batch in batches:
                out = []
                for row, text in enumerate(batch["text"].to_pylist()):
                    own: dict[int, list[int]] = {}
                    for k, start, _ in lexicon(text.lower()) if text else ():
                        own.setdefault(k, []).append(start)
                    out += [(row, k, len(at), min(at)) for k, at in own.items()]
                row, k, n, at = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row)), ids.take(pa.array(k)), pa.array(n), pa.array(at)], names=["doc_id", "phrase_id", "n", "first_start"])

        part = batched(docs).mapInArrow(find, "doc_id bigint, phrase_id bigint, n bigint, first_start bigint")
        found = part if found is None else found.unionByName(part)
    return found


def agreeing(docs: DataFrame, lexicon: DataFrame, ratio: float = RATIO, wild: Sequence[str] = ()) -> DataFrame:
    """doc_id, phrase_id, sent_no, t_start, t_end, hits, size: windows of a sentence's words that agree with a phrase of ``lexicon`` (phrase_id, words: lower-case words) in a share ``ratio`` at least. Phrases without words are nowhere."""
    found = None
    for rows in _blocks(lexicon.where("size(words) > 0").select("phrase_id", "words"), ["phrase_id", "words"]):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            look = Windows([r.words for r in sent.value], ratio, wild)
            ids = pa.array([r.phrase_id for r in sent.value], pa.int64())
            for batch in batches:
                s = Scanned(batch)
                if not s.sents:
                    continue
                at = words_only(s)
                phrase, start, hits = look(s.lower, s.word[at], s.sentence[at])
                first, last = at[start], at[start + look.size[phrase] - 1]
                sentence = s.sentence[first]
                made = [s.doc_ids.take(pa.array(np.array(s.doc, np.int64)[sentence])), ids.take(pa.array(phrase)), np.array(s.numbers)[sentence], s.start[first], s.start[last] + s.length[s.word[last]], hits, look.size[phrase]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["doc_id", "phrase_id", "sent_no", "t_start", "t_end", "hits", "size"])

        part = batched(docs).mapInArrow(find, "doc_id bigint, phrase_id bigint, sent_no int, t_start int, t_end int, hits int, size int")
        found = part if found is None else found.unionByName(part)
    return found


def windows_sql(phrases: Sequence[Sequence[str]], ratio: float = RATIO, wild: Sequence[str] = ()) -> str:
    """A query for DuckDB over tok: doc_id, sent_no, phrase (its number), t_start, t_end, hits of the windows that agree."""
    rows = ", ".join(f"({k}, {len(p)}, {needed(len(p), ratio) - sum(w in wild for w in p)}, {j}, '{w}')" for k, p in enumerate(phrases) for j, w in enumerate(p) if w not in wild)
    return agreeing_sql(f"(VALUES {rows}) px(phrase, size, need, place, w)")


def agreeing_sql(px: str) -> str:
    """The same for a table of phrases' words: phrase, size, need (words to agree), place (from 0), w."""
    return f"""SELECT h.doc_id, h.sent_no, phrase, a.t_start, b.t_end, hits, size FROM (
    SELECT doc_id, sent_no, phrase, k - place AS k, any_value(size) AS size, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY i) AS k FROM tok WHERE kind <> 'p') wi JOIN {px} ON px.w = wi.lower
    GROUP BY doc_id, sent_no, phrase, k - place HAVING count(*) >= any_value(need)) h
  JOIN (SELECT doc_id, sent_no, t_start, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY i) AS k FROM tok WHERE kind <> 'p') a ON a.doc_id = h.doc_id AND a.sent_no = h.sent_no AND a.k = h.k
  JOIN (SELECT doc_id, sent_no, t_end, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY i) AS k FROM tok WHERE kind <> 'p') b ON b.doc_id = h.doc_id AND b.sent_no = h.sent_no AND b.k = h.k + size - 1"""
