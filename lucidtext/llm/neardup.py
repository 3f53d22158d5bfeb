"""Near duplicates by a parity-sketch join on word shingles.

Two documents link when their shingle sets' Jaccard similarity reaches ``percent``.
With set sizes a <= b that means a symmetric difference of at most
``most_apart(a + b)`` and a ratio of sizes of at least ``percent``.

1. Equal sets share a node (128 bits of hash of the set), so copies are never paired.
2. Sizes fall into bands; a pair's sizes lie in one band or two neighbouring ones. For
   each band, tokens are XOR-hashed into P words of 64 parity bits. A token changes one
   word, so the number of differing words lower-bounds the symmetric difference; for at
   most d of them, one of any d + 1 words agrees. P is such that sets of the band have
   more than d words with a token in them: the first d + 1 of these are enough. (Of the
   first d + 1 of one set, one agrees with the other; take the first that does. What the
   other has before it are differing words, d at most, so it is among its first d + 1,
   too.) Sets with fewer send all their words. Pigeonhole join: nodes with a word in
   common fall into one bucket.
3. A finer sketch, one parity bit a token, lower-bounds the symmetric difference again and
   rejects most candidates; shingle sets decide about the others.
4. First each bucket's least node is compared with its others. What that links shares a
   label. Buckets of several others are compared by sketch in tiles of bounded size: the
   nearest pairs that join a tile's labels are checked, no more than it has labels. Of the
   other pairs that come near enough only the groups of nodes that they connect leave the
   task, once for however many buckets have the same group. These few nodes get larger
   sketches; the pairs of a group that come near enough by these and still have different
   labels are checked all. A pair within one label needs no check: it can't change the
   components.

Nothing quadratic leaves a task but pairs whose larger sketches come near enough and whose
sets then turn out not to link.

Documents with no words (null, empty) have no shingles and are linked with nothing. Fewer
words than a shingle has make one shingle. Null doc_ids take part and come last when a
component's smallest doc_id is sought; a component of such rows alone has a null
component_id. Rows that repeat are copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import _words
from ._shared import bound_batches, columns, few, mark, parts, release, settled, sweep, table, written
from .components import components

#: Members of a bucket that are compared in one task at most, twice over.
TILE = 1000
#: Fine sketches have so many bits for each token of the longest set of the band. Any number bounds the difference from below; sketches travel with pairs and members
#: of buckets, and with one bit sets that are far apart are still told from near ones.
FINE = 1
#: The larger sketches of nodes that the fine ones leave undecided have so many times the bits.
LARGER = 4


class Bands:
    """Size bands of a similarity of ``percent`` hundredths, and the sketches' sizes in each."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100")
        self.percent = percent
        self.low = [1]  # smallest size of each band

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            last = self.low[-1]
            self.low.append(max(last + 1, -(-last * 10_000 // self.percent**2)))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019  one object for each percent in a process
    def sizes(self, band: int) -> tuple[int, int, int]:
        """(d, words, fine bits) of a band's sketches."""
        low = self.low[band]
        self.band(low)
        top = self.low[band + 1] - 1
        d = self.most_apart(top + top * 100 // self.percent)
        words = d + 1
        # words that hold a token in a set of the smallest size, on average, less three deviations
        while words < 4 * d and words * (1 - (held := np.exp(-low / words))) - 3 * np.sqrt(words * held) < d + 1:
            words += max(1, words // 50)
        return d, words, FINE * (top + 1)

    def sets(self, n: int) -> list[int]:
        """Bands whose sketches a set of n tokens needs: its own, and the one below if it can be the larger of a pair."""
        own = self.band(n)
        return [own, own - 1] if own and n * self.percent <= 100 * (self.low[own] - 1) else [own]


@lru_cache(maxsize=4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def _spread(tokens: np.ndarray, seed: int) -> np.ndarray:
    return _words.mix(tokens ^ _words.mix(np.array([seed], np.uint64)))


def _below(h: np.ndarray, n: int) -> np.ndarray:
    """Even numbers below n from 32 bits of h."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def node_of(tokens: np.ndarray) -> bytes:
    """128 bits of hash of a set of distinct tokens: two independent sums over them."""
    with np.errstate(over="ignore"):
        sums = [np.bitwise_xor.reduce(_spread(tokens, 1)), _spread(tokens, 0).sum() + np.uint64(len(tokens))]
        return _words.mix(np.array(sums, np.uint64)).astype(">u8").tobytes()


def fine_sketch(tokens: np.ndarray, band: int, b: Bands, times: int = 1) -> bytes:
    bits = times * b.sizes(band)[2]
    odd = np.bincount(_below(_spread(tokens, 2 * band + 2), bits), minlength=bits) & 1
    packed = np.packbits(odd.astype(np.uint8))
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).tobytes()


def word_keys(tokens: np.ndarray, band: int, b: Bands) -> np.ndarray:
    """Join keys: for each word of the sketch that holds a token, a hash of its place and its parities; the lowest bit is the band's."""
    d, words, _ = b.sizes(band)
    if not d:
        return np.zeros(0, np.int64)  # only equal sets link
    h = _spread(tokens, 2 * band + 3)
    place = _below(h, words)
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    word = np.bitwise_xor.reduceat(_words.mix(h[order]), first)
    place = place[first]
    if len(place) <= d:  # too few words with tokens: those without count as well
        value = np.zeros(words, np.uint64)
        value[place] = word
        place, word = np.arange(words), value
    else:
        place, word = place[: d + 1], word[: d + 1]
    with np.errstate(over="ignore"):
        key = _words.mix(word + _words.mix((place + (band << 32)).astype(np.uint64)))
    return (key >> np.uint64(1) << np.uint64(1) | np.uint64(band & 1)).view(np.int64)


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    w = _words.words(texts, _words.NOT_SPACE, lower=True)
    h, doc = _words.shingles(w, k)
    order = np.argsort(doc, kind="stable")
    h, at = h[order], np.searchsorted(doc[order], np.arange(w.n_docs + 1))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


SKETCHED = "doc_id long, h long, n long, node binary, odd int, own binary, low binary, keys array<long>"


def _sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each document; the first of equal sets in a batch has its band's lowest bit, the fine sketches and the join keys of the coarse ones."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(percent)
        for batch in batches:
            sets = _sets(batch.column("text"), k)
            nodes, odd, own, low, keys, seen = [], [], [], [], [], set()
            for s in sets:
                node = node_of(s) if len(s) else None
                nodes.append(node)
                if node is None or node in seen:
                    odd.append(None)
                    own.append(None)
                    low.append(None)
                    keys.append(None)
                    continue
                seen.add(node)
                of = b.sets(len(s))
                odd.append(of[0] & 1)
                own.append(fine_sketch(s, of[0], b))
                low.append(fine_sketch(s, of[1], b) if len(of) > 1 else None)
                keys.append(np.concatenate([word_keys(s, band, b) for band in of]))
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(odd, pa.int32()), pa.array(own, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *made], names=[x.split()[0] for x in SKETCHED.split(", ")])
            del sets, nodes, odd, own, low, keys, made
            release()

    return docs.mapInArrow(sketch, SKETCHED)


def _nodes_of(column: pa.Array) -> np.ndarray:
    """A row of two numbers for each node."""
    column = column.cast(pa.binary(16))
    return np.frombuffer(column.buffers()[1], np.uint64)[2 * column.offset : 2 * (column.offset + len(column))].reshape(-1, 2)


def _buckets(rows: DataFrame, n_parts: int) -> DataFrame:
    """key, pivot, node, alone: all nodes of each bucket but the least, with that; is it seen to be the only one? Rows are read in order, so a bucket may have any size."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node, pivot = None, None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            key, nodes = batch.column("key").to_numpy(), batch.column("node")
            node = _nodes_of(nodes)
            same_key = np.concatenate([[last_key is not None and key[0] == last_key], key[1:] == key[:-1]])
            again = same_key & np.concatenate([[last_node is not None and (node[0] == last_node).all()], (node[1:] == node[:-1]).all(axis=1)])
            # the place of the bucket's first row; 0 stands for the pivot of the batch before
            begin = np.maximum.accumulate(np.where(same_key, 0, np.arange(1, len(key) + 1)))
            pivots = pa.concat_arrays([pa.array([pivot], nodes.type), nodes])
            out = same_key & ~again
            last_key, last_node, pivot = key[-1], node[-1].copy(), pivots[int(begin[-1])].as_py()
            # a row that repeats its pivot comes right after it, so it repeats the row before, too
            if out.any():
                at = np.flatnonzero(out)
                # the first and the last bucket of a batch may have more nodes in those beside it
                of = begin[at]
                more = (of == 0) | (of == begin[-1])
                more[1:] |= of[1:] == of[:-1]
                more[:-1] |= of[1:] == of[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pivots.take(pa.array(of)), nodes.take(pa.array(at)), pa.array(~more)], names=["key", "pivot", "node", "alone"])

    return rows.repartition(n_parts, "key").sortWithinPartitions("key", "node").mapInArrow(runs, "key long, pivot binary, node binary, alone boolean")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _near(percent: int):
    """A column function: can two sets link by their sizes and fine sketches?"""

    @F.arrow_udf(BooleanType())
    def near(n1: pa.Array, own1: pa.Array, low1: pa.Array, n2: pa.Array, own2: pa.Array, low2: pa.Array) -> pa.Array:
        b = bands(percent)
        out = []
        for a, ao, al, c, co, cl in zip(*(x.to_pylist() for x in (n1, own1, low1, n2, own2, low2)), strict=True):
            i, j = b.band(a), b.band(c)
            x, y = (ao, co) if i == j else (al, co) if i == j + 1 else (ao, cl) if j == i + 1 else (None, None)
            ok = x is not None and y is not None and 100 * min(a, c) >= percent * max(a, c)
            out.append(bool(ok and _apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= b.most_apart(a + c)))
        return pa.array(out)

    return near


def _linked(percent: int):
    """A column function: do two sorted shingle sets link?"""

    @F.arrow_udf(BooleanType())
    def linked(s1: pa.Array, s2: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(s1, s2, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out)

    return linked


def _forest(la: np.ndarray, lb: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs, the nearest first, join labels that the pairs before them leave apart."""
    order = np.lexsort([far, lb, la])
    first = np.concatenate([[True], (np.diff(la[order]) != 0) | (np.diff(lb[order]) != 0)])
    order = order[first]  # the nearest pair of each two labels
    order = order[np.argsort(far[order], kind="stable")]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for k, x, y in zip(order.tolist(), la[order].tolist(), lb[order].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(k)
    return np.array(out, np.int64)


def _grouped(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of 0 to n - 1 that pairs (i, j) connect each with."""
    root = np.arange(n)
    while True:
        least, low = root.copy(), np.minimum(root[i], root[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == root).all():
            return root
        root = least


CROSSING = "a binary, b binary, odd int, nodes array<binary>"


def _cross_pairs(percent: int, forest: bool):
    """mapInArrow function: tiles of a bucket -> pairs (a, b) of different labels whose sketches come near enough.

    forest: no more of them than join the labels; of the others the nodes that they connect, a row for each group of them, and the band's lowest bit. Else all.
    """

    def near(m: list[tuple], inside: bool) -> tuple[list[tuple[bytes, bytes]], list[list[bytes]]]:
        """Pairs and groups of members (tile, node, label, n, sketch) with sketches of one size."""
        names: dict[bytes, int] = {}
        tile, n = (np.array([x[i] for x in m], np.int64) for i in (0, 3))
        label = np.array([names.setdefault(x[2], len(names)) for x in m], np.int64)
        if len(names) < 2:
            return [], []
        sketch = np.frombuffer(b"".join(x[4] for x in m), np.uint64).reshape(len(m), -1)
        pairs = []
        for i in range(len(m) - 1):
            j = np.arange(i + 1, len(m))
            j = j[(label[j] != label[i]) & ((tile[j] != tile[i]) | inside) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            apart = _apart(sketch[j], sketch[i])
            close = apart <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
            pairs.append(np.stack([np.full(close.sum(), i), j[close], apart[close]]))
        i, j, apart = np.concatenate(pairs, axis=1)
        kept = _forest(np.minimum(label[i], label[j]), np.maximum(label[i], label[j]), apart) if forest and len(i) else np.arange(len(i))
        found = [tuple(sorted((m[x][1], m[y][1]))) for x, y in zip(i[kept].tolist(), j[kept].tolist(), strict=True)]
        i, j = np.delete(i, kept), np.delete(j, kept)
        root, groups = _grouped(i, j, len(m)), {}
        for x in np.unique(np.concatenate([i, j])).tolist():
            groups.setdefault(int(root[x]), []).append(m[x][1])
        return found, [sorted(g) for g in groups.values()]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(percent)
        for batch in batches:
            for row in batch.to_pylist():
                # should keys of several bands be equal, each band is on its own
                by_band: dict[int, list[tuple]] = {}
                for x in row["members"]:
                    own = b.band(x["n"])
                    by_band.setdefault(own if (own ^ row["key"]) & 1 == 0 else own - 1, []).append((x["tile"], x["node"], x["label"], x["n"], x["sketch"]))
                for of, m in by_band.items():
                    found, groups = near(m, row["ti"] == row["tj"]) if len(m) > 1 else ([], [])
                    if found or groups:
                        ends = [[x[k] for x in found] + [None] * len(groups) for k in (0, 1)]
                        made = [*(pa.array(x, pa.binary()) for x in ends), *(pa.array([None] * len(found) + x, t) for x, t in (([of & 1] * len(groups), pa.int32()), (groups, pa.list_(pa.binary()))))]
                        yield pa.RecordBatch.from_arrays(made, names=["a", "b", "odd", "nodes"])

    return cross


def _of(df: DataFrame, name: str, end: str) -> DataFrame:
    return df.select(*(F.col(c).alias(name if c == "node" else c + end) for c in df.columns))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _tokens(nodes: DataFrame, docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """node, tokens: the shingle sets of some nodes. ``reps``: a document of each node."""
    wanted = written(reps.join(nodes.distinct(), "node").select(F.col("doc_id").alias("rep_id"), F.col("h").alias("rep_h")), "reps")
    texts = docs.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {node_of(s): s.tobytes() for s in _sets(batch.column("text"), k) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in (found, found.values())], names=["node", "tokens"])

    # a text that repeats gives its node in several batches
    return written(texts.select("text").mapInArrow(sets, "node binary, tokens binary"), "sets").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b: nodes) whose shingle sets link."""
    both = pairs.join(_of(tokens, "a", "_a"), "a").join(_of(tokens, "b", "_b"), "b")
    return both.where(_linked(percent)("tokens_a", "tokens_b")).select("a", "b")


def _larger(tokens: DataFrame, percent: int) -> DataFrame:
    """node, n, odd, own, low: the larger sketches."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(percent)
        for batch in batches:
            rows = []
            for node, tokens in zip(batch.column("node").to_pylist(), batch.column("tokens"), strict=True):
                s = np.frombuffer(tokens.as_buffer(), np.uint64)
                of = b.sets(len(s))
                rows.append((node, len(s), of[0] & 1, fine_sketch(s, of[0], b, LARGER), fine_sketch(s, of[1], b, LARGER) if len(of) > 1 else None))
            types = zip(("node", "n", "odd", "own", "low"), (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)
            made = {name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(types)}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return tokens.mapInArrow(sketch, "node binary, n long, odd int, own binary, low binary")


def _signature() -> list[Column]:
    """What tells the members of a bucket: two independent 64-bit sums over them, the least and the greatest."""
    return [F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("other"), "node")).alias("s2"), F.min("node").alias("first"), F.max("node").alias("last")]


def _members(buckets: DataFrame) -> DataFrame:
    """key, node, tiles of the buckets of several nodes. The least node of a bucket, which has met all others already, isn't among them."""
    several = buckets.where("NOT alone").select("key", "node")
    keys = several.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *_signature()).where("size > 1")
    # buckets with the same members in the same band are compared once
    keys = keys.groupBy("size", "s1", "s2", "first", "last", F.expr("key & 1")).agg(F.min("key").alias("key"), F.ceil(F.first("size") / TILE).cast("int").alias("tiles"))
    return several.join(keys.select("key", "tiles"), "key")


def _crossing(members: DataFrame, near: DataFrame, labels: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs a, b of different labels in the same bucket, and the groups of those left out. ``near``: n, odd and sketches of the nodes."""
    named = near.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    # the key's lowest bit tells which of its bands a member is here for
    sketch = F.when(F.col("key").bitwiseAND(1) == F.col("odd"), F.col("own")).otherwise(F.col("low"))
    placed = members.join(named, "node").withColumns({"sketch": sketch, "tile": F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")}).where("sketch IS NOT NULL")
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), F.struct("tile", "node", "label", "n", "sketch").alias("m"))
    tiles = tiled.groupBy("key", "ti", "tj").agg(F.collect_list("m").alias("members"))
    return written(tiles.mapInArrow(_cross_pairs(percent, forest), CROSSING).distinct(), "crossing")


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n (size of the shingle set), node, class of each document; the class of linked documents is equal.

    ``docs`` has doc_id and text. Node and class are null without words.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    before = mark()
    sketched = written(_sketched(docs, k, percent), "sketched")
    keys = sketched.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "node")
    buckets = written(_buckets(keys, parts(docs)), "buckets")
    # most of the bytes are keys, which nothing needs any more
    sketched = written(sketched.drop("keys"), "slim")
    sweep(before, before + 1)
    met = buckets.select("node").unionByName(buckets.select(F.col("pivot").alias("node"))).distinct()
    # null doc_ids sort first in a struct; any document of the node will do
    mine = sketched.where("own IS NOT NULL").select("doc_id", "h", "n", "node", "odd", "own", "low").join(met, "node")
    nodes = written(mine.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("n").alias("n"), F.min("odd").alias("odd"), F.min("own").alias("own"), F.min("low").alias("low")), "nodes")
    reps, near = nodes.select("node", "rep.*"), nodes.select("node", "n", "odd", "own", "low")

    stars = buckets.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(_of(near, "a", "_a"), "a").join(_of(near, "b", "_b"), "b")
    stars = written(stars.where(_near(percent)("n_a", "own_a", "low_a", "n_b", "own_b", "low_b")).select("a", "b"), "stars")
    links = written(_confirmed(stars, _tokens(_ends(stars), docs, reps, k), percent), "links")
    labels = written(components(links, "a", "b"), "labels")

    # a spanning forest of each bucket's labels joins most of them; the pairs of those left are few
    crossing = _crossing(written(_members(buckets), "members"), near, labels, percent, forest=True)
    if not crossing.isEmpty():
        pairs, groups = crossing.where("nodes IS NULL").select("a", "b"), crossing.where("nodes IS NOT NULL").select("odd", "nodes")
        tokens = _tokens(_ends(pairs).unionByName(groups.select(F.explode("nodes").alias("node"))), docs, reps, k)
        links = written(links.unionByName(_confirmed(pairs, tokens, percent)), "links")
        labels = written(components(links, "a", "b"), "labels")
        # a group is a bucket of its own, with its band in the key's lowest bit
        numbered = groups.withColumn("key", F.shiftleft(F.monotonically_increasing_id(), 1).bitwiseOR(F.col("odd")))
        members = written(numbered.select("key", F.explode("nodes").alias("node"), F.lit(1).alias("tiles")), "members")
        pairs = _crossing(members, _larger(tokens, percent), labels, percent, forest=False).select("a", "b")
        if not pairs.isEmpty():
            links = written(links.unionByName(_confirmed(pairs, tokens, percent)), "links")
            labels = written(components(links, "a", "b"), "labels")
    final = labels.withColumnRenamed("component", "class")
    return sketched.select("doc_id", "h", "n", "node").join(final, "node", "left").select("doc_id", "h", "n", "node", F.coalesce("class", "node").alias("class"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row. Null texts and those without words have no shingles and are their own component; null ids are never the smallest; repeated rows are copies; without documents no rows."""
    found = settled(lambda: classes(table(spark, sf_dir, "documents"), 3, 90), "classes")
    # written apart from the join, which then can split a class of very many documents
    least = written(found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    return found.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of the smallest doc_id; columns stay.

    Null doc_ids come last. Of rows with the same doc_id and text one stays.
    """
    found = settled(lambda: classes(docs, 5, 80), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    heads = written(found.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("head")), "heads")
    rest = found.join(heads, "class").where(~order.eqNullSafe(F.col("head"))).select("doc_id", "h")
    rest = written(rest.distinct().select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "rest")
    row = docs.select(F.struct(*columns(docs)).alias("_row"))
    own_id, own_h = F.col("_row.doc_id").cast("long"), F.xxhash64("_row.text")
    same = own_id.eqNullSafe(F.col("_id")) & (own_h == F.col("_h"))
    kept = row.join(few(rest), same, "left_anti")
    again = found.where("class IS NOT NULL").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    again = written(again, "again")
    if not again.isEmpty():
        # counted down to one row before the shuffle, however often a row repeats
        several = kept.join(few(again), same, "left_semi").groupBy(own_id.alias("_id"), own_h.alias("_h")).agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        kept = kept.join(few(again), same, "left_anti").select("_row").unionByName(several.select("_row"))
    return kept.select("_row.*")


#: Shingle sets by hand and reachability by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS root, doc_id AS x FROM d UNION SELECT root, b FROM reach JOIN two ON x = a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.root) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""
