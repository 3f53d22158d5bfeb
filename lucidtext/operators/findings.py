"""What rules need to know of documents, found in one pass over the texts.

Word predicates are judged once for each distinct word of a batch. Only tokens that some rule asks for become rows, each
with the flags of the predicates it meets; sentences become rows with counts of what stands in them. A document is
read as a whole, so first occurrences, counts and pairs within it need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions.predicates import evaluated
from .annotate import Scanned, batched, spark_type
from .phrases import RATIO, Windows, words_only

NOT_SPACE = "[^ \\t\\n\\r\\f\\x0B]+"


@dataclass(frozen=True)
class Wanted:
    """What a scan is to find.

    words: flag -> predicate over words; flag k is bit k of ``flags``. tokens: flags whose tokens become rows. once: groups of flags; of
    each, a document's first token of a word has the group's first flag in ``first``, and ``n`` is how often it stands there.
    counts: column of a sentence -> predicate over words. parens: patterns counted in a sentence. joined, cased: patterns over
    a sentence's words and its text; these are given only where one of them is found. undefined: a flag that goes where the
    document itself explains the word in brackets. phrases: (phrase, meaning, tenths of difficulty, category or none).
    Of an idiom, which has a category, 0.8 of the words and 8 tenths are asked for: ``harder`` words of a sentence add 3, more than 15 words 2,
    two ``animals`` 4; ``literal`` words mean no idiom; ``placeholders`` stand for any word. Others must be found word by word. pairs: (word, plainer word, synonyms). marks: (name, pattern, what
    to call it if not by what is found) over whole texts. texts: whether each document's text and ``about`` are given on; keep: columns of whole numbers
    that are given on with it.
    """

    words: tuple[tuple[str, str], ...] = ()
    tokens: tuple[str, ...] = ()
    once: tuple[tuple[str, ...], ...] = ()
    counts: tuple[tuple[str, str], ...] = ()
    syllables: str = ""
    long: str = ""
    parens: tuple[str, ...] = ()
    joined: str | None = None
    cased: str | None = None
    sentences: bool = False
    means: bool = False
    undefined: str = ""
    explained: str = ""
    foreign: str = ""
    phrases: tuple[tuple[str, str, int, str], ...] = ()
    harder: tuple[str, ...] = ()
    animals: tuple[str, ...] = ()
    placeholders: tuple[str, ...] = ()
    literal: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    marks: tuple[tuple[str, str, str | None], ...] = ()
    texts: bool = False
    keep: tuple[str, ...] = ()

    def bit(self, flag: str) -> int:
        return 1 << [name for name, _ in self.words].index(flag)


def schema(want: Wanted) -> pa.Schema:
    """what: t a token, s a sentence, i a phrase, y a pair of synonyms, m a mark, d a document's means, x its text.

    row numbers the documents, whatever their doc_id; the rows of a batch of documents follow each other and have its number in batch.
    """
    text, number = pa.string(), pa.int32()
    fixed = [("row", pa.int64()), ("batch", pa.int64()), ("doc_id", pa.int64()), ("what", text), ("sent_no", number), ("t_start", number), ("t_end", number), ("text", text), ("lower", text), ("n_syll", number), ("i", number), ("prev1", text), ("next1", text), ("next2", text)]
    fixed += [("flags", pa.int64()), ("first", pa.int64()), ("n", number), ("s_foreign", number), ("s_tokens", number), ("s_words", number)]
    of_sentence = [(name, number) for name, _ in want.counts] + [(x, number) for x in ("syll_counted", "n_paren", "n_split")] + [(x, text) for x in ("last_token", "joined", "long_flags")]
    return pa.schema(fixed + of_sentence + [(c, pa.int64()) for c in want.keep])


def _join(s: Scanned) -> pa.Array:
    """The words of each sentence in lower case, with blanks between them."""
    lists = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), s.lower.take(pa.array(s.word)))
    return pc.binary_join(lists, " ")


def _padded(joined: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" "), joined, pa.scalar(" "), pa.scalar(""))


def _only(values: pa.Array, keep: pa.Array) -> pa.Array:
    return pc.if_else(keep, values, pa.scalar(None, values.type))


@lru_cache(maxsize=4)
def _windows(want: Wanted) -> Windows:
    return Windows([p.split() for p, *_ in want.phrases], RATIO, want.placeholders)


class _Batch:
    """One batch's rows."""

    def __init__(self, batch: pa.RecordBatch, want: Wanted, number: int = 0) -> None:
        self.want, self.schema, self.batch, self.number = want, schema(want), batch, number
        self.s = s = Scanned(batch)
        self.of_word = s.words()
        self.flags = np.zeros(len(s.text), np.int64)
        for k, (_, predicate) in enumerate(want.words):
            self.flags |= evaluated(predicate, self.of_word).astype(np.int64) << k
        self.doc = np.array(s.doc, np.int64)

    def rows(self, of: np.ndarray | list[int], what: str, /, **given: pa.Array | np.ndarray | list) -> pa.RecordBatch:
        """``of``: the document of each row, by its place in the batch."""
        of = np.asarray(of, np.int64)
        many = len(of)
        given |= {"row": of + self.number, "batch": np.full(many, self.number), "doc_id": self.batch["doc_id"].take(pa.array(of)), "what": [what] * many}
        return pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x, f.type)) if (x := given.get(f.name)) is not None else pa.nulls(many, f.type) for f in self.schema], schema=self.schema)

    def per_sentence(self, of_words: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_words[self.s.word].astype(np.int32), self.s.first[:-1])

    def of(self, sentences: np.ndarray) -> np.ndarray:
        return np.array(self.s.row, np.int64)[self.doc[sentences]]

    def mask(self, flags: tuple[str, ...]) -> int:
        return sum(self.want.bit(f) for f in flags)

    def _first(self, tokens: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the groups of which it is a document's first of its word, and how often the word stands there."""
        s = self.s
        # words are the same if they agree in lower case, signs if they are equal
        lower = s.lower.dictionary_encode().indices.to_numpy().astype(np.int64)
        sign = pc.equal(s.kind, "p").to_numpy(zero_copy_only=False)
        name = np.where(sign, np.arange(len(lower)) + len(lower), lower)[s.word[tokens]]
        key = self.doc[s.sentence[tokens]] * (2 * len(lower)) + name
        first, n = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        for group in self.want.once:
            at = np.flatnonzero(flags & self.mask(group))
            _, begin, many = np.unique(key[at], return_index=True, return_counts=True)
            first[at[begin]] |= self.want.bit(group[0])
            n[at[begin]] = many
        return first, n

    def tokens(self, s_words: np.ndarray | None, s_foreign: np.ndarray | None) -> pa.RecordBatch | None:
        s, asked = self.s, self.mask(self.want.tokens)
        tokens = np.flatnonzero((self.flags & asked)[s.word])
        flags = self.flags[s.word[tokens]] & asked
        if self.want.undefined and len(tokens):
            bit = self.want.bit(self.want.undefined)
            hit = np.flatnonzero(flags & bit)
            lower, pattern = s.lower.take(pa.array(s.word[tokens[hit]])).to_pylist(), re.compile(self.want.explained)
            known: dict[int, set[str]] = {}
            for k, word in zip(hit.tolist(), lower, strict=True):
                d = int(self.doc[s.sentence[tokens[k]]])
                if d not in known:
                    known[d] = {x.lower() for x in pattern.findall(s.texts[s.row[d]])}
                if word in known[d]:
                    flags[k] &= ~bit
            tokens, flags = tokens[flags != 0], flags[flags != 0]
        if not len(tokens):
            return None
        first, n = self._first(tokens, flags)
        at = s.sentence[tokens]
        i, start, end, text, lower, _, syll, prev1, next1, next2 = s.columns(tokens)
        more = {}
        if s_words is not None and s_foreign is not None:
            more = {"s_words": s_words[at], "s_foreign": s_foreign[at], "s_tokens": np.diff(s.first)[at]}
        return self.rows(self.of(at), "t", sent_no=np.array(s.numbers)[at], t_start=start, t_end=end, text=text, lower=lower, n_syll=syll, i=i, prev1=prev1, next1=next1, next2=next2, flags=flags, first=first, n=n, **more)

    def sentences(self, joined: pa.Array, counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        s, want = self.s, self.want
        sents = pa.array(s.sents, pa.string())
        long = evaluated(want.long, self.of_word) if want.long else np.zeros(len(s.text), bool)
        # one sign for each token: the sentences' bounds are those of their tokens
        signs = pa.Array.from_buffers(pa.string(), len(s.sents), [None, pa.py_buffer(s.first.astype(np.int32)), pa.py_buffer((long[s.word] + ord("0")).astype(np.uint8))])
        syll = np.where(evaluated(want.syllables, self.of_word), s.n_syll, 0) if want.syllables else np.zeros(len(s.text), np.int64)
        parens = sum((pc.count_substring_regex(sents, p).to_numpy() for p in want.parens), np.zeros(len(sents), np.int32))
        cased = _only(sents, pc.match_substring_regex(sents, want.cased)) if want.cased else None
        kept = joined if want.joined == "" else _only(joined, pc.match_substring_regex(_padded(joined), want.joined)) if want.joined else None
        return self.rows(
            self.of(np.arange(len(sents))), "s", sent_no=s.numbers, t_start=s.begins, t_end=s.ends, text=sents, lower=cased, syll_counted=self.per_sentence(syll), n_paren=parens,
            n_split=pc.count_substring_regex(sents, NOT_SPACE), last_token=s.text.take(pa.array(s.word[s.first[1:] - 1])), joined=kept, long_flags=signs, **counts,
        )

    def phrases(self, s_words: np.ndarray) -> pa.RecordBatch | None:
        s, want = self.s, self.want
        look = _windows(want)
        at = words_only(s)
        phrase, start, hits = look(s.lower, s.word[at], s.sentence[at])
        done, found = set(), []
        for p, a, b, n in zip(phrase.tolist(), at[start].tolist(), at[start + look.size[phrase] - 1].tolist(), hits.tolist(), strict=True):
            (name, meaning, tenths, category), k = want.phrases[p], int(s.sentence[a])
            key = (s.doc[k], p)
            if key in done:
                continue
            if category:
                low = s.sents[k].lower()
                own = s.lower.take(pa.array(s.word[s.first[k] : s.first[k + 1]])).to_pylist()
                tenths += (2 if s_words[k] > 15 else 0) + (3 if any(x in low for x in want.harder) else 0) + (4 if sum(any(x in w for x in want.animals) for w in own) > 1 else 0)
                if tenths < 8 or any(x in low for x in want.literal):
                    continue
            elif n < look.size[p]:
                continue
            done.add(key)
            found.append((k, s.start[a], s.start[b] + s.length[s.word[b]], name, meaning, category, tenths))
        if not found:
            return None
        k, begin, end, text, lower, category, tenths = zip(*found, strict=True)
        k = np.array(k)
        return self.rows(self.of(k), "i", sent_no=np.array(s.numbers)[k], t_start=np.array(begin), t_end=np.array(end), text=list(text), lower=list(lower), next1=list(category), n=list(tenths))

    def pairs(self) -> pa.RecordBatch | None:
        s = self.s
        asked = {x for w, _, others in self.want.pairs for x in (w, *others)}
        tokens = np.flatnonzero(evaluated("kind = 'w'", self.of_word)[s.word] & pc.is_in(s.lower, value_set=pa.array(sorted(asked))).to_numpy(zero_copy_only=False)[s.word])
        where: dict[int, dict[str, int]] = {}
        for token, d, word in zip(tokens.tolist(), self.doc[s.sentence[tokens]].tolist(), s.lower.take(pa.array(s.word[tokens])).to_pylist(), strict=True):
            where.setdefault(d, {}).setdefault(word, token)
        found = [(d, own[w], w, plain, other) for d, own in where.items() if len(own) > 1 for w, plain, others in self.want.pairs if w in own for other in others if other in own]
        if not found:
            return None
        d, token, word, plain, other = zip(*found, strict=True)
        token = np.array(token)
        start = s.start[token]
        return self.rows(np.array(s.row, np.int64)[np.array(d)], "y", sent_no=np.array(s.numbers)[s.sentence[token]], t_start=start, t_end=start + s.length[s.word[token]], text=list(word), lower=list(other), next1=list(plain))

    def marks(self) -> pa.RecordBatch | None:
        patterns = [(name, re.compile(p), fixed) for name, p, fixed in self.want.marks]
        some = pc.match_substring_regex(self.batch["text"], "|".join(f"(?:{p})" for _, p, _ in self.want.marks))
        texts = [(row, self.s.texts[row]) for row in np.flatnonzero(pc.fill_null(some, False)).tolist()]
        found = [(row, name, x) for row, text in texts for name, p, fixed in patterns for x in dict.fromkeys(fixed or m for m in p.findall(text))]
        if not found:
            return None
        row, name, text = zip(*found, strict=True)
        return self.rows(row, "m", text=list(text), lower=list(name))

    def all(self) -> Iterator[pa.RecordBatch]:
        want, s = self.want, self.s
        kept = {c: self.batch[c] for c in want.keep}
        out = [self.rows(np.arange(self.batch.num_rows), "x", text=self.batch["text"], lower=self.batch["about"] if "about" in self.batch.schema.names else None, **kept)] if want.texts else []
        out += [self.marks()] if want.marks else []
        if len(s.word):
            counts = {name: self.per_sentence(evaluated(p, self.of_word)) for name, p in want.counts}
            joined = _join(s) if want.sentences else None
            s_foreign = self.per_sentence(evaluated(want.foreign, self.of_word)) if want.foreign else None
            words = counts.get("n_words")
            if want.tokens:
                out.append(self.tokens(words, s_foreign))
            if want.sentences:
                out.append(self.sentences(joined, counts))
            if want.phrases:
                out.append(self.phrases(words))
            if want.pairs:
                out.append(self.pairs())
            if want.means:
                first = np.flatnonzero(np.diff(self.doc, prepend=-1))
                sums, many = np.add.reduceat(words, first), np.diff(np.append(first, len(self.doc)))
                out.append(self.rows(s.row, "d", s_words=sums, n=many))
        return (x for x in out if x is not None)


def findings(docs: DataFrame, want: Wanted) -> DataFrame:
    """Rows of ``schema(want)``. ``docs`` has doc_id and text, where texts are wanted about (a string), too, or the columns to keep; each row of it is a document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield from _Batch(batch, want, number).all()
            number += batch.num_rows

    return batched(docs, *(want.keep or (["about"] if want.texts else []))).mapInArrow(find, spark_type(schema(want)))
