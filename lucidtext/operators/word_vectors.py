"""Vectors of words from the corpus itself, and words that mean about the same.

Words (capitalised ones of more than three letters, as nouns are written, that stand in
``MIN_COUNT`` places) get the words around them, ``WINDOW`` to each side within a
sentence, as contexts. A context's weight is its positive pointwise mutual information;
a vector is the sum, over the contexts, of the weight times the context's signs, 128 of
them from hashes: a random projection, so no matrix is kept anywhere. Vectors have
length 1; cosines are products.

``neighbours`` finds all pairs from a cosine on. The exact way compares blocks with
blocks. The index assigns vectors to cells around centres, fitted on a sample of at most
``SAMPLE`` vectors, and compares a word with the words of its ``PROBES`` nearest cells;
all words are indexed.

``clusters`` groups a document's words: in the order in which they first stand there, each
word that has no group yet opens one, and takes in later ones from a cosine on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.folders import through_folder
from .annotate import Scanned, batched
from .joins import looked_up

WINDOW = 4
MIN_COUNT = 5
SIMILAR = 0.65
SIZE = 128
SAMPLE = 20_000
PROBES = 12
#: Vectors in a block.
BLOCK = 1_024
#: Vectors that are compared with all centres at once; rows that leave a batch of texts at once.
PIECE, ROWS = 256, 50_000

# --- quality of a word: least share of all words and what it adds, longest and what it adds; fixed values
FREQUENT = ((0.001, 0.4), (0.0001, 0.3), (0.00001, 0.2))
SHORT = ((4, 0.3), (6, 0.2), (8, 0.1))


def _words(s: Scanned) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are words; whether each is one that gets a vector."""
    word = pc.equal(s.kind, "w").to_numpy(zero_copy_only=False)
    noun = pc.match_substring_regex(s.text, r"^\p{Lu}").to_numpy(zero_copy_only=False) & (s.length > 3)
    at = np.flatnonzero(word[s.word])
    return at, noun[s.word[at]]


def contexts(docs: DataFrame) -> DataFrame:
    """word, context, n: how often a context stands near a word (both in lower case; a null context: how often the word stands somewhere)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Scanned(batch)
            if not s.sents:
                continue
            at, noun = _words(s)
            lower = s.lower.dictionary_encode()
            number = lower.indices.to_numpy().astype(np.int64)[s.word[at]]
            sentence = s.sentence[at]
            many = len(lower.dictionary) + 1
            keys = [number[noun] * many + many - 1]
            for k in range(1, WINDOW + 1):
                near = sentence[k:] == sentence[:-k]
                a, b = number[:-k], number[k:]
                keys += [(a * many + b)[near & noun[:-k]], (b * many + a)[near & noun[k:]]]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            for k in range(0, len(key), ROWS):
                word, context = key[k : k + ROWS] // many, key[k : k + ROWS] % many
                yield pa.RecordBatch.from_arrays([lower.dictionary.take(pa.array(word)), lower.dictionary.take(pa.array(context, mask=context == many - 1)), pa.array(n[k : k + ROWS])], names=["word", "context", "n"])

    return batched(docs).mapInArrow(count, "word string, context string, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n"))


@F.arrow_udf(BinaryType())
def _signs(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for x in np.stack([a.to_numpy(), b.to_numpy()], 1).astype("<i8")], pa.binary())


def vectors(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n, vector (128 floats as bytes) of the words of ``docs``; words without a positive context have none. Written."""
    c = through_folder(contexts(docs), "contexts")
    own = through_folder(c.where(f"context IS NULL AND n >= {min_count}").select("word", F.col("n").alias("times")), "words")
    pairs = through_folder(c.where("context IS NOT NULL").join(own.select("word"), "word", "left_semi"), "pairs")
    of_word = pairs.groupBy("word").agg(F.sum("n").alias("word_n"), F.count(F.lit(1)).alias("rows"))
    of_context = through_folder(pairs.groupBy("context").agg(F.sum("n").alias("context_n"), F.count(F.lit(1)).alias("rows")), "of_context")
    total = float(of_context.agg(F.sum("context_n")).first()[0] or 0)
    both = looked_up(pairs, of_context, ["context"], "rows")
    both = looked_up(both, through_folder(of_word, "of_word"), ["word"], "rows")
    weighed = both.select("word", (F.log(F.col("n") * F.lit(total)) - F.log(F.col("word_n")) - F.log(F.col("context_n"))).alias("w"), _signs(F.xxhash64(F.lit(1), "context"), F.xxhash64(F.lit(2), "context")).alias("signs")).where("w > 0")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch["word"].dictionary_encode()
            which = coded.indices.to_numpy().astype(np.int64)
            bits = np.unpackbits(np.frombuffer(b"".join(batch["signs"].to_pylist()), np.uint8).reshape(len(which), -1), axis=1)
            rows = (2.0 * bits - 1.0) * batch["w"].to_numpy()[:, None]
            order = np.argsort(which, kind="stable")
            first = np.flatnonzero(np.diff(which[order], prepend=-1))
            sums = np.add.reduceat(rows[order], first) if len(first) else rows[:0]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(which[order][first])), pa.array([r.tobytes() for r in sums], pa.binary())], names=["word", "part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SIZE)
        for batch in batches:
            done = []
            for word, part in zip(batch["word"].to_pylist(), batch["part"].to_pylist(), strict=True):
                if word != now:
                    done += [(now, total)] if now is not None else []
                    now, total = word, np.zeros(SIZE)
                total = total + np.frombuffer(part, "<f8")
            yield _normal(done)
        yield _normal([(now, total)] if now is not None else [])

    # parts of a word are summed where they were made, then in order of their bytes, so that reruns agree
    parts = weighed.sortWithinPartitions("word").mapInArrow(partial, "word string, part binary").repartition("word").sortWithinPartitions("word", "part")
    return through_folder(parts.mapInArrow(joined, "word string, vector binary").join(own.withColumnRenamed("times", "n"), "word"), "vectors")


def _normal(rows: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    kept = [(w, (v / np.linalg.norm(v)).astype("<f4").tobytes()) for w, v in rows if np.linalg.norm(v) > 0]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.binary())], names=["word", "vector"])


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), SIZE)


def centres(found: DataFrame, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of cells, from a sample of at most ``SAMPLE`` vectors by chance of the words."""
    n = found.count()
    some = found.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 0.9 * SAMPLE / max(n, 1))))).select("vector").limit(SAMPLE)
    x = _matrix([bytes(r.vector) for r in some.orderBy("vector").collect()])
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy() if len(x) else np.zeros((1, SIZE), "<f4")
    for _ in range(rounds):
        at = (x @ c.T).argmax(1) if len(x) else np.zeros(0, int)
        for k in np.unique(at):
            mean = x[at == k].mean(0)
            c[k] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return c


def nearest(x: np.ndarray, where: np.ndarray, probes: int) -> np.ndarray:
    """For each vector the ``probes`` nearest centres, nearest first; some vectors at a time, since each is compared with all centres."""
    probes = min(probes, len(where))
    near = np.empty((len(x), probes), np.int64)
    for k in range(0, len(x), PIECE):
        near[k : k + PIECE] = np.argsort(-(x[k : k + PIECE] @ where.T), axis=1, kind="stable")[:, :probes]
    return near


def _blocks(found: DataFrame, where: np.ndarray | None, probes: int) -> DataFrame:
    """cell, words, vectors: blocks of at most ``BLOCK`` vectors of a cell; with probes, each vector in that many cells."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["vector"].to_pylist())
            near = nearest(x, where, probes)
            row = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch["word"].take(pa.array(row)), batch["vector"].take(pa.array(row))], names=["cell", "word", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch["cell"].to_numpy()
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(cell), BLOCK), [len(cell)]]))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            made = [cell[cuts[:-1]], [batch["word"].slice(a, b - a).to_pylist() for a, b in spans], [b"".join(batch["vector"].slice(a, b - a).to_pylist()) for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.list_(pa.string())), pa.array(made[2], pa.binary())], names=["cell", "words", "vectors"])

    placed = found.select("word", "vector").mapInArrow(cells, "cell int, word string, vector binary") if where is not None else found.select(F.lit(0).alias("cell"), "word", "vector")
    # a large cell is spread over several partitions
    spread = placed.repartition("cell", F.pmod(F.xxhash64("word"), F.lit(8))).sortWithinPartitions("cell", "word")
    return through_folder(spread.mapInArrow(pack, "cell int, words array<string>, vectors binary"), "blocks")


def neighbours(found: DataFrame, least: float = SIMILAR, exact: bool = False, probes: int = PROBES) -> DataFrame:
    """word, other, cosine: pairs of different words of ``found`` (word, vector) from ``least`` on, both ways. ``exact``: blocks of all words against blocks of all words."""
    n = found.count()
    cells = max(1, min(1_024, n // 64))
    where = None if exact or cells == 1 else centres(found, cells)
    index = _blocks(found, where, 1).select("cell", "words", "vectors")
    asked = (index if where is None else _blocks(found, where, probes)).select("cell", F.col("words").alias("q_words"), F.col("vectors").alias("q_vectors"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, x = (np.frombuffer(batch[c][i].as_py(), "<f4").reshape(-1, SIZE) for c in ("q_vectors", "vectors"))
                a, b = batch["q_words"][i].values, batch["words"][i].values
                c = q @ x.T
                j, k = np.nonzero(c >= least)
                pair = pa.RecordBatch.from_arrays([a.take(pa.array(j)), b.take(pa.array(k)), pa.array(c[j, k].astype(np.float64))], names=["word", "other", "cosine"])
                yield pair.filter(pc.not_equal(pair["word"], pair["other"]))

    pairs = asked.join(index, "cell").select("q_words", "q_vectors", "words", "vectors")
    return pairs.mapInArrow(compare, "word string, other string, cosine double")


def quality(word: Column, share: Column) -> Column:
    """How well a word suits plain language; ``share``: of all words of the corpus."""
    frequent = F.coalesce(*(F.when(share > least, more) for least, more in FREQUENT), F.lit(0.0))
    short = F.coalesce(*(F.when(F.length(word) <= longest, more) for longest, more in SHORT), F.lit(0.0))
    low = F.lower(word)
    stock = F.when(low.contains("tion") | low.contains("ment"), -0.1).when(low.contains("ung") | low.contains("heit") | low.contains("keit"), 0.2).otherwise(0.0)
    return frequent + short + stock + F.when(word.rlike("^[a-zA-ZäöüÄÖÜß]+$"), 0.1).otherwise(0.0)


def _places(docs: DataFrame) -> DataFrame:
    """row (numbers the documents), doc_id, word, place: where each word that may have a vector first stands."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            s = Scanned(batch)
            if s.sents:
                at, noun = _words(s)
                at = at[noun]
                doc = np.array(s.doc, np.int64)[s.sentence[at]]
                lower = s.lower.dictionary_encode()
                word = lower.indices.to_numpy().astype(np.int64)[s.word[at]]
                _, first = np.unique(doc * len(lower.dictionary) + word, return_index=True)
                row = np.array(s.row, np.int64)[doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(row + number), batch["doc_id"].take(pa.array(row)), lower.dictionary.take(pa.array(word[first])), pa.array(s.start[at[first]], pa.int32())], names=["row", "doc_id", "word", "place"])
            number += batch.num_rows

    return batched(docs).mapInArrow(find, "row bigint, doc_id bigint, word string, place int")


def clusters(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, words (in order, at least two), best (of most quality, the first of equals) of each group of ``docs``' words that ``pairs`` (word, other) connects; ``found`` has word and n."""
    places = through_folder(_places(docs), "places")
    total = float(found.agg(F.sum("n")).first()[0] or 1)
    known = through_folder(found.select("word", quality(F.col("word"), F.col("n") / F.lit(total)).alias("quality")), "known")
    others = through_folder(pairs.groupBy("word").agg(F.collect_set("other").alias("others")), "others")
    # how many documents have each word: the join's frequent keys
    often = places.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    more = through_folder(often.join(known, "word").join(others, "word"), "more")
    mine = through_folder(looked_up(places, more, ["word"], "rows").where("others IS NOT NULL"), "mine")
    met = mine.select("row", "word", F.explode("others").alias("other")).join(mine.select("row", F.col("word").alias("other")), ["row", "other"]).groupBy("row", "word").agg(F.collect_set("other").alias("met"))
    own = mine.select("row", "doc_id", "word", "place", "quality").join(met, ["row", "word"])
    lists = own.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "word", "quality", "met"))).alias("own"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, own in zip(batch["doc_id"].to_pylist(), batch["own"].to_pylist(), strict=True):
                taken: set[str] = set()
                for k, x in enumerate(own):
                    if x["word"] in taken:
                        continue
                    members = [x] + [y for y in own[k + 1 :] if y["word"] in set(x["met"]) and y["word"] not in taken]
                    taken |= {y["word"] for y in members}
                    if len(members) > 1:
                        out.append((doc_id, [y["word"] for y in members], max(members, key=lambda y: round(y["quality"], 9))["word"]))
            doc, words, best = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(best, pa.string())], names=["doc_id", "words", "best"])

    return lists.select("doc_id", "own").mapInArrow(group, "doc_id bigint, words array<string>, best string")
