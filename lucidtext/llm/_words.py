"""Words of whole Arrow batches of texts, found with byte tables.

All word classes of the operators tell ASCII characters apart and take every other
character as part of a word (or as none), so they can be read off the UTF-8 bytes:
one table lookup a byte, no regular expression and no Python object for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, as a table for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_class(outside: str) -> np.ndarray:
    """True for each byte that belongs to a word; ``outside``: the ASCII characters that don't."""
    t = np.ones(256, dtype=bool)
    t[[ord(c) for c in outside]] = False
    return t


#: [^\x20\x09-\x0D]
NOT_SPACE = byte_class(" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing: digits, a-z and all beyond ASCII
ALNUM = byte_class("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


@dataclass
class Words:
    """Words of a batch in reading order."""

    n_docs: int
    data: bytes  #: all texts, one after the other
    text_start: np.ndarray  #: of each text in data, and the end
    start: np.ndarray  #: of each word in data
    end: np.ndarray
    first: np.ndarray  #: number of the first word of each text, and the number of all words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(self.n_docs), self.counts())

    def values(self) -> pa.Array:
        """The words themselves, without the bytes between them."""
        raw = np.frombuffer(self.data, dtype=np.uint8)
        offsets = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        edge = np.zeros(len(raw) + 1, dtype=np.int8)
        edge[self.start] = 1
        edge[self.end] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words; the words by number."""
        if not len(self.start):
            return np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
        coded = self.values().dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of all texts in one piece, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return b"", np.zeros(1, dtype=np.int64)
    body = texts.buffers()[2]
    data = body[int(offsets[0]) : int(offsets[-1])].to_pybytes() if body is not None else b""
    return data, offsets - offsets[0]


def words(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    data, at = text_bytes(texts)
    if lower:
        data = data.translate(LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = table[raw]
    # a word begins where a word byte follows another byte or the end of the text before
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(raw))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    return Words(len(at) - 1, data, at, start, end, np.searchsorted(start, at))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a bijection of 64-bit numbers that spreads them evenly."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words, alike on every machine."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of all texts and the text of each, repeats included.

    A text of fewer than k words, but of some, has one shingle: all its words.
    """
    ids, distinct = w.ids()
    h = word_hashes(distinct)[ids] if len(ids) else np.zeros(0, dtype=np.uint64)
    n = w.counts()
    with np.errstate(over="ignore"):
        doc = w.doc()
        # words left in the text from each word on
        left = np.repeat(w.first[1:], n) - np.arange(len(h))
        full = left >= k
        out = np.zeros(int(full.sum()), dtype=np.uint64)
        at = np.flatnonzero(full)
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + j])
        docs = doc[at]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            tail = np.zeros(len(short), dtype=np.uint64)
            for j in range(k - 1):
                has = n[short] > j
                tail[has] = mix(tail[has] * np.uint64(0x9E3779B97F4A7C15) + h[w.first[short][has] + j])
            out, docs = np.concatenate([out, mix(tail + n[short].astype(np.uint64))]), np.concatenate([docs, short])
    return out, docs
