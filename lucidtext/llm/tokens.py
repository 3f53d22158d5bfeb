"""Token ids in wavelet matrix files.

Documents go to shards in ascending doc_id order; each shard becomes one file that
holds its ids as a wavelet matrix: for every bit of an id, from the highest, a plane
of bits in an order that the planes above decide, with a directory of counts. The
file answers what id stands at a place, how often an id occurs in a range and where,
by unpacking only the blocks that the question touches, and can be decoded as a whole.

File: b"WVM2", then little-endian uint32 length of a JSON header, the header, and
zstandard blocks in the header's order: doc_ids (int64), known (uint8, 0: null
doc_id), lengths (int64), for each bit its directory (uint32 count of ones before each
512 bits), and for each bit the plane (packed bits, lowest first) in blocks of ``PLANE`` bytes.
There are as many bits as the tokenizer's largest id needs.

Null and empty texts have the end id alone. Equal doc_ids stand in the order of a hash of
their texts; null doc_ids stand first. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words
from ._shared import bound_batches, parts, release, table, written

END = 2
#: A file is closed at so many ids, at the end of the document that reaches it.
FILE_IDS = 4_000_000
#: Text bytes encoded at once: ids and offsets take many times as much.
BATCH_BYTES = 2 << 20
BLOCK = 512
#: Bytes of a plane that are compressed together.
PLANE = 1 << 15
#: Distinct pieces of texts whose ids a worker remembers, and the bytes and ids it remembers before it begins anew.
REMEMBERED = 400_000
REMEMBERED_SIZE = 24 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_KIND = np.full(256, 3, np.uint8)  # 0: white space, 1: letter, 2: a sign that tokens don't join with letters, 3: anything else
_KIND[list(b" \t\n\v\f\r")] = 0
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~")] = 2  # not ', which begins contractions, nor |, which special tokens hold


def pieces(texts: pa.Array) -> _words.Words:
    """Texts cut where no token spans: at white space, and between Latin letters and most ASCII signs.

    The tokenizer folds case, so ASCII letters are folded here already, unless a
    special token may stand in the texts: those are told by case.
    """
    data, at = _words.text_bytes(texts)
    if b"<|" not in data:
        data = data.translate(_words.LOWER)
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    pair = np.flatnonzero(raw[:-1] == 0xC3)  # the letters of Latin-1: no composition, no change of length
    pair = pair[(raw[pair + 1] != 0x97) & (raw[pair + 1] != 0xB7)]
    kind[pair] = kind[pair + 1] = 1
    begin = kind > 0
    # 1 beside 2 is a cut, and so is any white space
    begin[1:] &= (kind[:-1] == 0) | (kind[1:] ^ kind[:-1] == 3) & (kind[1:] != 0)
    edges = at[(at > 0) & (at < len(raw))]
    begin[edges] = kind[edges] > 0
    start = np.flatnonzero(begin)
    stop = (kind > 0) & np.concatenate([begin[1:] | (kind[1:] == 0), [True]]) if len(raw) else begin
    stop[edges - 1] = kind[edges - 1] > 0
    return _words.Words(len(at) - 1, data, at, start, np.flatnonzero(stop) + 1, np.searchsorted(start, at))


_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# byte-level vocabularies write printable Latin-1 bytes as they are, and the others from U+0100 on
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordEncoder:
    """Encodes texts by their distinct pieces; a worker remembers pieces that it has met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _LETTERS.fullmatch
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # piece -> its place in flat << 32 | number of ids
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.held = 0  # bytes of the pieces in known

    def _direct(self, piece: str) -> list[int]:
        """Ids of a word of Latin letters: past folding and cutting, only the library's merges are left to do."""
        piece = piece.lower()
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_SIGNS))]

    def _learn(self, new: list[bytes]) -> None:
        for k in range(0, len(new), 2_000):
            part = new[k : k + 2_000]
            texts = [x.decode() for x in part]
            rest = [x for x in texts if not self.letters(x)]
            coded = dict(zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
            ids = [coded[x].ids if x in coded else self._direct(x) for x in texts]
            many = list(map(len, ids))
            while self.used + sum(many) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + sum(many)] = list(chain.from_iterable(ids))
            starts = np.cumsum([self.used, *many])
            self.used = int(starts[-1])
            self.held += sum(map(len, part))
            self.known.update(zip(part, (starts[:-1] << 32 | np.array(many)).tolist(), strict=True))

    def __call__(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end`` after each text, and how many each text has."""
        w = pieces(texts)
        ids, distinct = w.ids()
        own = distinct.to_pylist()
        new = [x for x in own if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED or self.held + self.used > REMEMBERED_SIZE:
            self._forget()
            new = own
        self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        size, begin = place & 0xFFFFFFFF, (place >> 32).astype(np.int32)  # what is remembered has fewer than 2 ** 31 ids
        many = size[ids]
        ends = np.concatenate([[0], np.cumsum(many)])
        lengths = ends[w.first[1:]] - ends[w.first[:-1]] + 1
        # where each id stands in flat: a piece's ids follow one another
        source = np.repeat((begin[ids] - ends[:-1]).astype(np.int32 if ends[-1] < 1 << 31 else np.int64), many)
        source += np.arange(len(source), dtype=source.dtype)
        out = np.full(int(lengths.sum()), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = self.flat[source]
        return out, lengths


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder: what it remembers serves all tasks that the worker runs."""
    return WordEncoder(path)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, bits: int = 16) -> bytes:
    """The file of one shard."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"ids of more than {bits} bits")
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, planes, ones = [], [], []
    for b in range(bits - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << b)) != 0
        plane = np.packbits(bit, bitorder="little")
        plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
        count = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        ones.append(_pack((np.cumsum(count) - count).astype("<u4")))
        planes += [_pack(plane[k : k + PLANE]) for k in range(0, len(plane), PLANE)]
        low = cur[~bit]
        zeros.append(len(low))
        cur = np.concatenate([low, cur[bit]])
    blocks = [_pack(doc_ids.astype("<i8")), _pack(known.astype(np.uint8)), _pack(lengths.astype("<i8")), *ones, *planes]
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "blocks": [len(x) for x in blocks]}).encode()
    return b"".join([b"WVM2", struct.pack("<I", len(head)), head, *blocks])


class WaveletFile:
    """Reads a file made by ``encode_file``; a block is unpacked when it is first needed."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"WVM2":
            raise ValueError("not a wavelet matrix file")
        (k,) = struct.unpack("<I", data[4:8])
        head = json.loads(data[8 : 8 + k])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self._data, self._at = data, np.concatenate([[0], np.cumsum(head["blocks"])]) + 8 + k
        self._unpacked: dict[int, bytes] = {}
        self._each = (len(head["blocks"]) - 3 - self.bits) // self.bits  # blocks of a plane
        self.doc_ids, self.known, self.lengths = np.frombuffer(self._block(0), "<i8"), np.frombuffer(self._block(1), np.uint8).astype(bool), np.frombuffer(self._block(2), "<i8")

    def _block(self, k: int, keep: bool = True) -> bytes:
        raw = self._unpacked.get(k)
        if raw is None:
            raw = zstandard.decompress(self._data[self._at[k] : self._at[k + 1]])
            if keep:
                self._unpacked[k] = raw
        return raw

    def _ones(self, level: int) -> np.ndarray:
        return np.frombuffer(self._block(3 + level), "<u4")

    def _bytes(self, level: int, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi of a plane, of one block of it."""
        return np.frombuffer(self._block(3 + self.bits + level * self._each + lo // PLANE), np.uint8)[lo % PLANE : lo % PLANE + hi - lo]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        ones = self._ones(level)
        if not len(ones):
            return 0
        block = min(i // BLOCK, len(ones) - 1)
        bits = np.unpackbits(self._bytes(level, block * BLOCK // 8, (block + 1) * BLOCK // 8), count=i - block * BLOCK, bitorder="little")
        return int(ones[block]) + int(bits.sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bytes(level, i // 8, i // 8 + 1)[0] >> i % 8 & 1
            ones = self._rank1(level, i)
            value = value << 1 | int(bit)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id stands in places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of an id's k-th occurrence, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            # the place where so many ones (or zeros) stand before, and one itself
            before = self._ones(level).astype(np.int64)
            if not one:
                before = np.arange(len(before)) * BLOCK - before
            block = int(np.searchsorted(before, want, side="right")) - 1
            bits = np.unpackbits(self._bytes(level, block * BLOCK // 8, (block + 1) * BLOCK // 8), bitorder="little")
            at = block * BLOCK + int(np.flatnonzero(bits == one)[want - int(before[block])])
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            first = 3 + self.bits + level * self._each
            plane = np.frombuffer(b"".join(self._block(k, keep=False) for k in range(first, first + self._each)), np.uint8)
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(cur)
            out[~bit] = cur[: self.zeros[level]]
            out[bit] = cur[self.zeros[level] :] | cur.dtype.type(1 << (self.bits - 1 - level))
            cur = out
        return cur


FILES = "shard string, n_tokens long, file binary"


def bits_for(path: str) -> int:
    """Bits of the largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(END, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()).bit_length()


def write_files(docs: DataFrame, path: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files: shard (in doc_id order), n_tokens, file."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH_BYTES)
    bits = bits_for(path)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        encoder = encoder_of(path)
        held: list[tuple] = []
        many = 0

        def file() -> pa.RecordBatch:
            ids, doc_ids, known, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [f"{part:08d}-{k:06d}", len(ids), encode_file(ids, doc_ids, known, lengths, bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), pa.int64(), pa.binary()], strict=True)], names=["shard", "n_tokens", "file"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lengths = encoder(batch.column("text"))
            doc_id = batch.column("doc_id")
            held.append((ids.astype(np.uint16 if bits <= 16 else np.uint32), doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False), lengths))
            many += len(ids)
            if many >= file_ids:
                yield file()
                held, many, k = [], 0, k + 1
            del ids, lengths
            release()
        if held:
            yield file()

    # rows of one doc_id, null above all, may fill many partitions: the hash of the text and, for rows that repeat, the row's place tell them apart
    order = [F.col("doc_id"), F.col("_h"), F.col("_row")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(build, FILES)


DOCS = "shard string, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = WaveletFile(batch.column("file")[i].as_py())
                ids = f.tokens().astype("<u4")
                ends = np.cumsum(f.lengths)
                starts = ends - f.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                shard = pa.array([batch.column("shard")[i].as_py()] * len(starts), pa.string())
                del ids
                yield pa.RecordBatch.from_arrays([shard, pa.array(f.doc_ids, pa.int64(), mask=~f.known), pa.array(starts, pa.int64()), pa.array(f.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])

    # ids before each part, then before each file of a part: one row for each part meets in a task
    part = F.substring("shard", 1, 8).alias("part")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = files.select("shard", part, "n_tokens")
    of_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    bases = sizes.withColumn("inner", before(Window.partitionBy("part").orderBy("shard"))).join(of_part, "part").select("shard", (F.col("base") + F.col("inner")).alias("base"))
    docs = files.select("shard", "file").mapInArrow(read, DOCS)
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op5_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """A row for each document row. Null texts are empty: the end id alone; null ids come first; repeated rows are encoded each, one after the other; without documents no rows."""
    return stage_tokens(spark, table(spark, sf_dir, "documents"), sf_dir, tokenizer)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """op5 over ``docs``; columns besides doc_id and text are not read."""
    return read_files(written(write_files(docs, tokenizer or tokenizer_path()), "tokens"))
