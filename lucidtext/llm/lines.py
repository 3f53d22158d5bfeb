r"""Line dedup with a log-template tree of fixed depth.

Lines are cut at \n and into tokens at ASCII white space; a token with a digit is a
variable field from the start. The tree's first level is a line's number of tokens, the
next ``DEPTH`` levels are its leading tokens; a leaf is what agrees in all of these.
Within a leaf, a token stands for itself where at least ``MIN_TEXTS`` texts have it at
its place; any other token becomes a variable field. What remains is the line's
template. A template that lines of at least ``MIN_TEXTS`` different texts share recurs,
and if enough of its tokens are constant, its lines are dropped from every document.
Lines that are the same token for token, digits included, need no template: from
``MIN_SAME`` different texts on they recur as they are, and shorter ones, of fewer than
``MIN_CONSTANT`` tokens but with a letter, from ``MIN_SHORT`` on.

All steps are grouped counts over all documents, so the result doesn't depend on the
order in which lines are read. A line that very many documents have is collapsed to
one row, with its number of texts, before anything is joined; only for lines of fewer
than ``MIN_TEXTS`` texts are the texts themselves counted together with those of other
lines. Lines outside frequent leaves that no other text has never leave the scan: bit
tables of fixed size tell them apart, and exact joins follow.

Texts that are equal count once; rows that repeat lose the same lines. Blank lines and
short ones without a letter (a bracket, a page number) stay. Null texts stay null and
empty ones empty; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bound_batches, few, table, written

DEPTH = 4
MIN_TEXTS = 5
#: Texts from which a line recurs that is the same in all of them.
MIN_SAME = 2
#: And for lines too short for a template.
MIN_SHORT = 20
#: Constant tokens that a template needs, and their share of its tokens.
MIN_CONSTANT, MIN_SHARE = 5, 0.6
#: The bit table's size doesn't depend on the corpus: 8 MB. When it fills up, more lines are left to the join.
TABLE_BITS = 26

_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_DIGIT = re.compile(rb"[0-9]")
_LETTER = re.compile(rb"[A-Za-z\x80-\xFF]")
_WILD = b"<*>"


def _hash(x: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(x)).view(np.int64))


def _leaves(text: bytes) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(line number, leaf, hash of all tokens, line) of the lines; no leaf for those too short for a template."""
    for i, line in enumerate(text.split(b"\n")):
        own = line.split()
        if len(own) >= MIN_CONSTANT:
            lead = (_WILD if _DIGIT.search(t) else t for t in own[:DEPTH])
            yield i, _hash(b"%d\0" % len(own) + b"\0".join(lead)), _hash(b" ".join(own)), line
        elif _LETTER.search(line):
            yield i, None, _hash(b" ".join(own)), line


def _seen(docs: DataFrame) -> DataFrame:
    """key, same, h: once for each leaf (0), each line that has one (1) and each shorter line (2) of each text."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, same, h = [], [], []
            done: set[int] = set()
            for x, t in zip(batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t and x not in done:
                    done.add(x)
                    own = set()
                    for _, leaf, line, _ in _leaves(t):
                        if leaf is None:
                            own.add((line, 2))
                        else:
                            own |= {(leaf, 0), (line, 1)}
                    key += [k for k, _ in own]
                    same += [k for _, k in own]
                    h += [x] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(same, pa.int8()), pa.array(h, pa.int64())], names=["key", "same", "h"])

    return docs.select("h", "text").mapInArrow(seen, "key long, same byte, h long")


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit for each key: bytes set by partitions and joined by OR, of fixed size."""
    placed = keys.select(F.shiftrightunsigned("key", 64 - TABLE_BITS).alias("place"))
    words = placed.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()  # at most 2 ** (TABLE_BITS - 6) rows
    out = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


LINES = "doc_id long, h long, line int, leaf long, masked string, whole long"


def _candidates(docs: DataFrame, bits: np.ndarray, same: np.ndarray) -> DataFrame:
    """Lines in leaves whose bit is set, with their variable fields masked, and lines whose own bit is set: ``masked`` or ``whole`` is null otherwise."""
    sent = docs.sparkSession.sparkContext.broadcast((bits, same))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_bits, line_bits = sent.value

        def has(table: np.ndarray, key: int) -> int:
            place = (key & 0xFFFFFFFFFFFFFFFF) >> (64 - TABLE_BITS)
            return int(table[place >> 6]) >> (place & 63) & 1

        for batch in batches:
            out: list[tuple] = []
            for d, x, t in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for i, leaf, whole, line in _leaves(t) if t else ():
                    mine, own = leaf is not None and has(leaf_bits, leaf), has(line_bits, whole)
                    if mine or own:
                        out.append((d, x, i, leaf, b" ".join(_FIELD.sub(_WILD, line).split()).decode() if mine else None, whole if own else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in LINES.split(", ")])

    return docs.mapInArrow(candidates, LINES)


def recurring(docs: DataFrame, min_texts: int = MIN_TEXTS, min_same: int = MIN_SAME, min_short: int = MIN_SHORT) -> tuple[DataFrame, DataFrame]:
    """(lines, templates): the lines to drop as doc_id, h, line; and leaf, template (a hash), n_texts, example of what recurs as a template.

    ``docs`` has doc_id (long), h (a hash of the text) and text.
    """
    least = F.when(F.col("same") == 0, min_texts).when(F.col("same") == 1, min_same).otherwise(min_short)
    keys = written(_seen(docs).groupBy("same", "key").agg(F.countDistinct("h").alias("texts")).where(F.col("texts") >= least).select("same", "key"), "keys")
    leaves, same = keys.where("same = 0").select("key"), keys.where("same > 0").select("key")
    found = written(_candidates(docs, _bits(leaves), _bits(same)), "lines")
    alike = found.where("whole IS NOT NULL").join(few(same.withColumnRenamed("key", "whole")), "whole", "left_semi").select("doc_id", "h", "line")
    lines = found.where("masked IS NOT NULL").join(few(leaves.withColumnRenamed("key", "leaf")), "leaf", "left_semi").withColumn("hash", F.xxhash64("masked"))
    # one row for each distinct line, however many documents have it
    distinct = lines.select("leaf", "hash", "masked", "h").distinct().groupBy("leaf", "hash", "masked").agg(F.count(F.lit(1)).alias("texts"))
    distinct = written(distinct.withColumnRenamed("hash", "line"), "distinct")
    # a line of min_texts texts decides for its tokens and its template alone; of rarer ones the texts are told apart
    rare = few(distinct.where(F.col("texts") < min_texts).select("leaf", F.col("line").alias("hash")))
    rare = written(lines.join(rare, ["leaf", "hash"], "left_semi").select("leaf", F.col("hash").alias("line"), "h").distinct(), "rare")

    def enough(by: list[str], named: DataFrame) -> DataFrame:
        """Groups that lines of at least ``min_texts`` different texts have; ``named``: groups of lines (leaf, line, texts)."""
        sums = named.groupBy(*by).agg(F.max("texts").alias("most"), F.sum("texts").alias("sum")).where(F.col("sum") >= min_texts)
        sure = sums.where(F.col("most") >= min_texts).select(*by)
        # what rare lines reach together, if at all
        open_ = sums.where(F.col("most") < min_texts).select(*by)
        asked = written(named.where(F.col("texts") < min_texts).join(few(open_, len(by)), by, "left_semi").select("line", *by), "asked")
        told = asked.join(rare, ["leaf", "line"]).select(*by, "h").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_texts).select(*by)
        return written(sure.unionByName(told), "enough")

    # tokens travel as hashes; a template is known by the exclusive or of its constant places
    tokens = distinct.select("leaf", "line", "texts", F.posexplode(F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).alias("place", "token"))
    plain = tokens.where(F.col("token") != F.xxhash64(F.lit(_WILD.decode())))
    constant = enough(["leaf", "place", "token"], plain).withColumn("mark", F.xxhash64("place", "token"))
    marked = tokens.join(constant, ["leaf", "place", "token"], "left").select("leaf", "line", "mark")
    held = marked.groupBy("leaf", "line").agg(F.count("mark").alias("constants"), F.count(F.lit(1)).alias("size"), F.bit_xor("mark").alias("template"))
    held = held.where((F.col("constants") >= MIN_CONSTANT) & (F.col("constants") >= MIN_SHARE * F.col("size"))).select("leaf", "line", "template")
    templates = written(distinct.join(held, ["leaf", "line"]), "templates")
    drop = templates.join(few(enough(["leaf", "template"], templates)), ["leaf", "template"], "left_semi")
    gone = lines.join(few(drop.select("leaf", F.col("line").alias("hash"))), ["leaf", "hash"], "left_semi").select("doc_id", "h", "line")
    # counted only if it is asked for
    texts = lines.join(drop.select("leaf", "template", F.col("line").alias("hash")), ["leaf", "hash"]).groupBy("leaf", "template").agg(F.countDistinct("h").alias("n_texts"), F.min("masked").alias("example"))
    return gone.unionByName(alike), texts


def without_lines(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs`` (doc_id, h, text) with n_lines, n_dropped and the text that is left."""
    lists = written(drop.distinct().groupBy("doc_id", "h").agg(F.collect_set("line").alias("drop")).withColumnsRenamed({"doc_id": "_id", "h": "_h"}), "drop")
    joined = docs.join(few(lists, F.size("drop") + 2), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    all_lines = F.split(F.col("text"), "\n", -1)
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    return joined.select("doc_id", "h", F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row. Null texts have no lines; blank lines stay; repeated rows count as one text and lose the same lines; without documents no rows."""
    bound_batches(spark)
    docs = keyed(table(spark, sf_dir, "documents"))
    drop, _ = recurring(docs)
    left = without_lines(docs, drop)
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.when(F.col("text").isNull() & (F.col("n_dropped") == 0), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
