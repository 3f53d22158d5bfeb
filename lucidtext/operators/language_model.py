"""A trigram model with interpolated Kneser-Ney smoothing, fitted and used by joins of counts.

Sentences are tokens in lower case: letters in a row and the signs . , ! ?; sentences of
fewer than ``MIN_TOKENS`` are left out. Two <s> stand before a sentence and one </s>
after it; every token and the </s> is predicted from the two before it.

With the discount d, counts c of trigrams, and ab. for all trigrams that begin so:

    P(w | a b) = max(c(abw) - d, 0) / c(ab.) + d * types(ab.) / c(ab.) * P(w | b)
    P(w | b)   = max(n(bw) - d, 0) / n(b.) + d * types(b.) / n(b.) * P(w)
    P(w)       = n(w) / n

where n counts the different words that come before: n(bw) different a, n(w) different b.
The probabilities of all words after a context sum to 1. A context that was never seen
gives its weight to the shorter one; a word that was never seen has no probability.

Counting is one pass over the texts: words are numbered in a batch and only its distinct
trigrams leave it. Contexts that very many trigrams have are sent to all executors
instead of being gathered in one task (``joins``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import dropped, shuffles_dropped, through_folder
from .annotate import SENTENCE, batched
from .joins import FREQUENT, looked_up  # noqa: F401  tests set it here, too

DISCOUNT = 0.1
MIN_TOKENS = 3
START, END = "<s>", "</s>"
_SENTENCE, _TOKEN = regex.compile(SENTENCE), regex.compile(r"\p{L}+|[.,!?]")
GRAM = ("w1", "w2", "w3")
#: Slices of the texts whose trigrams are on their way to their probabilities at once.
SLICES = 4


def _trigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int], pa.Array]:
    """Words by number (three rows: w1, w2, w3) of each trigram, its sentence; row and number of each sentence; the words."""
    words, sizes, rows, numbers = [START, END], [], [], []
    for row, text in enumerate(pc.utf8_lower(batch["text"]).to_pylist()):
        for no, m in enumerate(_SENTENCE.finditer(text or ""), 1):
            own = _TOKEN.findall(m[0])
            if len(own) >= MIN_TOKENS:
                words += own
                sizes.append(len(own))
                rows.append(row)
                numbers.append(no)
    coded = pa.array(words, pa.string()).dictionary_encode()
    n = np.array(sizes, np.int64)
    # two starts, the tokens, an end
    ends = np.cumsum(n + 3)
    padded = np.zeros(int(ends[-1]) if len(n) else 0, np.int64)
    inner = np.ones(len(padded), bool)
    for k in (ends - n - 3, ends - n - 2, ends - 1):
        inner[k] = False
    padded[ends - 1] = 1
    padded[inner] = coded.indices.to_numpy()[2:]
    at = np.ones(len(padded), bool)
    for k in (ends - n - 3, ends - n - 2):
        at[k] = False
    last = np.flatnonzero(at)
    return np.stack([padded[last - 2], padded[last - 1], padded[last]]), np.repeat(np.arange(len(n)), n + 1), n, rows, numbers, coded.dictionary


def _distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First of each distinct column of numbers below ``size``, and how often it stands there."""
    key = np.zeros(keys.shape[1], np.int64)
    for part in keys:  # exact however large the numbers are: pairs are numbered anew
        key = np.unique(key * size + part, return_inverse=True)[1]
    _, first, many = np.unique(key, return_index=True, return_counts=True)
    return first, many


def _listed(docs: DataFrame) -> DataFrame:
    """w1, w2, w3, n: trigrams of each batch of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, _, _, _, _, words = _trigrams(batch)
            first, many = _distinct(grams, len(words))
            yield pa.RecordBatch.from_arrays([*(words.take(pa.array(g[first])) for g in grams), pa.array(many, pa.int64())], names=[*GRAM, "n"])

    return batched(docs).mapInArrow(count, "w1 string, w2 string, w3 string, n bigint")


def counted(docs: DataFrame) -> DataFrame:
    """w1, w2, w3, n: trigrams of all sentences."""
    return _listed(docs).groupBy(*GRAM).agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """g (words with blanks between them), n: the grams of whole texts, with ``order`` - 1 starts before and ends after each. Null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = [START, END], []
            for text in pc.utf8_lower(batch["text"]).to_pylist():
                if text is not None:
                    own = _TOKEN.findall(text)
                    words += own
                    sizes.append(len(own))
            coded = pa.array(words, pa.string()).dictionary_encode()
            n, pad = np.array(sizes, np.int64), order - 1
            ends = np.cumsum(n + 2 * pad)
            padded = np.zeros(int(ends[-1]) if len(n) else 0, np.int64)
            inner, begins = np.ones(len(padded), bool), np.ones(len(padded), bool)
            for k in range(1, pad + 1):
                padded[ends - k] = 1
                inner[ends - k] = inner[ends - n - 2 * pad + k - 1] = False
                begins[ends - k] = False
            padded[inner] = coded.indices.to_numpy()[2:]
            at = np.flatnonzero(begins)
            grams = np.stack([padded[at + j] for j in range(order)])
            first, many = _distinct(grams, len(coded.dictionary))
            joined = pc.binary_join_element_wise(*(coded.dictionary.take(pa.array(g[first])) for g in grams), " ")
            yield pa.RecordBatch.from_arrays([joined, pa.array(many, pa.int64())], names=["g", "n"])

    return batched(docs).mapInArrow(count, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def of_sentences(docs: DataFrame) -> DataFrame:
    """row (numbers the documents), doc_id, sent_no, size (tokens predicted), w1, w2, w3, k: the trigrams of each sentence."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            grams, sentence, n, rows, numbers, words = _trigrams(batch)
            first, many = _distinct(np.concatenate([sentence[None], grams]), max(len(words), len(n)) + 1)
            s = sentence[first]
            row = np.array(rows, np.int64)[s] if len(s) else s
            made = [pa.array(row + number), batch["doc_id"].take(pa.array(row)), pa.array(np.array(numbers, np.int64)[s] if len(s) else s, pa.int32()), pa.array(n[s] + 1, pa.int32()), *(words.take(pa.array(g[first])) for g in grams), pa.array(many, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "sent_no", "size", *GRAM, "k"])
            number += batch.num_rows

    return batched(docs).mapInArrow(list_, "row bigint, doc_id bigint, sent_no int, size int, w1 string, w2 string, w3 string, k int")


@dataclass
class Model:
    """Tables: trigrams (w1, w2, w3, a3), contexts of two (w1, w2, g2, types), bigrams (w2, w3, a2, before), contexts of one (w2, g1, types), words (w3, p, before)."""

    trigrams: DataFrame
    pairs: DataFrame
    bigrams: DataFrame
    singles: DataFrame
    words: DataFrame

    def save(self, path: str) -> None:
        """A Parquet folder for each table."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(Model)))

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """``grams`` (w1, w2, w3 and more, each trigram once) with p: 0 for a word that was never seen."""
        seen = grams.join(self.trigrams, list(GRAM), "left")  # one to one
        seen = looked_up(through_folder(seen, "seen"), self.pairs, ["w1", "w2"], "types")
        seen = looked_up(through_folder(seen, "seen"), self.bigrams, ["w2", "w3"], "before")
        seen = looked_up(through_folder(seen, "seen"), self.singles, ["w2"], "types")
        seen = looked_up(through_folder(seen, "seen"), self.words, ["w3"], "before")
        return seen.select(*grams.columns, smoothed().alias("p"))


def smoothed() -> Column:
    or_ = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    return or_("a3", 0.0) + or_("g2", 1.0) * (or_("a2", 0.0) + or_("g1", 1.0) * or_("p", 0.0))


def fitted(docs: DataFrame, discount: float = DISCOUNT) -> Model:
    """The model of the sentences of ``docs`` (doc_id, text); its tables are written."""
    d = F.lit(discount)
    left = lambda n: F.greatest(n - d, F.lit(0.0))
    t = through_folder(counted(docs), "trigrams")
    pairs = through_folder(t.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")), "pairs")
    b = through_folder(t.groupBy("w2", "w3").agg(F.count(F.lit(1)).alias("before")), "bigrams")
    singles = through_folder(b.groupBy("w2").agg(F.sum("before").alias("total"), F.count(F.lit(1)).alias("types")), "singles")
    n_bigrams = F.lit(float(b.count()))
    words = through_folder(b.groupBy("w3").agg(F.count(F.lit(1)).alias("before")).select("w3", (F.col("before") / n_bigrams).alias("p"), "before"), "words")
    weight = lambda name: (d * F.col("types") / F.col("total")).alias(name)
    trigrams = looked_up(t, pairs.select("w1", "w2", "total", "types"), ["w1", "w2"], "types").select(*GRAM, (left(F.col("n")) / F.col("total")).alias("a3"))
    bigrams = looked_up(b, singles, ["w2"], "types").select("w2", "w3", (left(F.col("before")) / F.col("total")).alias("a2"), "before")
    return Model(through_folder(trigrams, "a3"), pairs.select("w1", "w2", weight("g2"), "types"), through_folder(bigrams, "a2"), singles.select("w2", weight("g1"), "types"), words)


def of_all(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """w1, w2, w3, n, p: every trigram of ``docs`` with its probability under the model of ``docs``.

    The same as ``fitted`` and ``probabilities``, but a trigram brings its sums with it: trigrams are moved to those with the same first two words, then to those with the same last
    two. So many trigrams share two words as there are words that stand next to these, so no group is large. The sums of single words are looked up.
    """
    return _of_all(docs, discount)[0]


def _of_all(docs: DataFrame, discount: float) -> tuple[DataFrame, list[DataFrame]]:
    """``of_all``, and the tables that were written for it."""
    d = F.lit(discount)
    left = lambda n: F.greatest(n - d, F.lit(0.0))
    first, last = Window.partitionBy("w1", "w2"), Window.partitionBy("w2", "w3")
    t = _listed(docs).repartition("w1", "w2").groupBy(*GRAM).agg(F.sum("n").alias("n")).select(*GRAM, "n", F.sum("n").over(first).alias("total"), F.count(F.lit(1)).over(first).alias("types"))
    b = t.select("*", F.count(F.lit(1)).over(last).cast("int").alias("before"), (F.row_number().over(last.orderBy("w1")) == 1).alias("new"))
    b = through_folder(b, "trigrams")
    shuffles_dropped(docs.sparkSession)
    singles = through_folder(b.groupBy("w2").agg(F.count(F.lit(1)).alias("total1"), F.count_if("new").alias("types1")), "singles")
    words = through_folder(b.where("new").groupBy("w3").agg(F.count(F.lit(1)).alias("n3")).join(b.groupBy("w3").agg(F.count(F.lit(1)).alias("rows")), "w3"), "words")
    n_bigrams = F.lit(float(words.agg(F.sum("n3")).first()[0] or 1))
    both = looked_up(looked_up(b, singles.withColumn("rows", F.col("total1")), ["w2"], "rows"), words, ["w3"], "rows")
    p1 = left(F.col("before")) / F.col("total1") + d * F.col("types1") / F.col("total1") * (F.col("n3") / n_bigrams)
    p = both.select(*GRAM, "n", (left(F.col("n")) / F.col("total") + d * F.col("types") / F.col("total") * p1).alias("p"))
    return p, [b, singles, words]


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, sent_no, n_tokens, log_perplexity (of a token; null where a word was never seen) of each sentence. Rows that share a doc_id stay apart."""
    each = through_folder(of_sentences(docs), "grams")
    asked = through_folder(each.groupBy(*GRAM).agg(F.count(F.lit(1)).alias("many")), "asked")
    scored = looked_up(each, through_folder(model.probabilities(asked), "scored"), list(GRAM), "many")
    return _of_sentences(scored)


def _of_batches(docs: DataFrame) -> DataFrame:
    """Each distinct trigram of a batch of texts, with the places of the sentences that have it (``at``, as often as they do); one row of a batch has its sentences instead (``own``: doc_id, whether it has one, sent_no, size)."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            grams, sentence, n, rows, numbers, words = _trigrams(batch)
            if not len(n):
                continue
            key = np.zeros(grams.shape[1], np.int64)
            for part in grams:
                key = np.unique(key * len(words) + part, return_inverse=True)[1]
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            # numbers as bytes: Spark turns lists into rows and back very slowly
            places, ends = sentence[order].astype("<i4").tobytes(), np.append(begins, len(order)) * 4
            at = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(places)])
            ids = batch["doc_id"].take(pa.array(rows, pa.int64()))
            own = np.stack([pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False), np.array(numbers), n + 1]).astype("<i8").tobytes()
            none = pa.nulls(1, pa.string())
            made = [pa.concat_arrays([words.take(pa.array(g[order[begins]])), none]) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begins) + 1, number)), *made, pa.concat_arrays([at, pa.nulls(1, pa.binary())]), pa.concat_arrays([pa.nulls(len(begins), pa.binary()), pa.array([own], pa.binary())])], names=["batch", *GRAM, "at", "own"])
            number += 1

    return batched(docs).mapInArrow(list_, "batch bigint, w1 string, w2 string, w3 string, at binary, own binary")


def _batch_scored(t: pa.Table) -> pa.Table:
    """doc_id, sent_no, n_tokens, log_perplexity of the sentences of one of ``_of_batches``, whose trigrams have p."""
    doc_id, has, sent_no, n = np.frombuffer(t["own"].drop_null()[0].as_py(), "<i8").reshape(4, -1)
    t = t.filter(pc.is_valid(t["at"]))
    raw = t["at"].to_pylist()
    p = np.repeat(pc.fill_null(t["p"], 0.0).to_numpy(), np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw)))
    at, seen = np.frombuffer(b"".join(raw), "<i4"), p > 0
    total = np.bincount(at, np.log(np.where(seen, p, 1.0)), len(n))
    lost = np.bincount(at, ~seen, len(n)) > 0
    return pa.table({"doc_id": pa.array(doc_id, mask=has == 0), "sent_no": pa.array(sent_no, pa.int32()), "n_tokens": pa.array(n, pa.int32()), "log_perplexity": pa.array(-total / n, mask=lost)})


def own_perplexities(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``perplexities`` under the model of ``docs`` themselves: all their trigrams are known, so none is asked for, and the texts are read again instead of written as trigrams.

    A trigram is asked for once by a batch of texts, so that even the most frequent one has few rows; probabilities go back to their batch, where sentences are summed up.
    What was shuffled and written for a table is deleted once the next one stands, and the texts go through the join in slices, so that disk holds the trigrams of one of them.
    """
    spark = docs.sparkSession
    made, tables = _of_all(docs, discount)
    known = through_folder(made.drop("n"), "known")
    dropped(spark, *tables)
    shuffles_dropped(spark)
    scored = []
    for k in range(SLICES):
        own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k)
        scored.append(through_folder(_of_batches(own).join(known, list(GRAM), "left").select(F.lit(k).alias("slice"), "batch", "at", "p", "own"), "scored"))
        shuffles_dropped(spark)
    dropped(spark, known)
    return reduce(DataFrame.unionByName, scored).groupBy("slice", "batch").applyInArrow(_batch_scored, "doc_id bigint, sent_no int, n_tokens int, log_perplexity double")


def _of_sentences(scored: DataFrame) -> DataFrame:
    lost = F.sum(F.when(F.col("p") > 0, 0).otherwise(1))
    total = F.sum(F.when(F.col("p") > 0, F.col("k") * F.log("p")))
    per = scored.groupBy("row", "doc_id", "sent_no", "size").agg(lost.alias("lost"), total.alias("total"))
    return per.select("doc_id", "sent_no", F.col("size").alias("n_tokens"), F.when(F.col("lost") == 0, -F.col("total") / F.col("size")).alias("log_perplexity"))


#: The same by windows over tokens: tables kn (w1, w2, w3, c, p) and gr (doc_id, sent_no, w1, w2, w3).
MODEL_SQL = rf"""ls AS (SELECT doc_id, sent_no, list_concat(['<s>', '<s>'], w, ['</s>']) AS w FROM (SELECT doc_id, sent_no, regexp_extract_all(lower(text), '\p{{L}}+|[.,!?]') AS w FROM s) WHERE len(w) >= {MIN_TOKENS}),
gr AS (SELECT doc_id, sent_no, unnest(w[1:len(w) - 2]) AS w1, unnest(w[2:len(w) - 1]) AS w2, unnest(w[3:]) AS w3 FROM ls),
t3 AS (SELECT w1, w2, w3, count(*) AS c FROM gr GROUP BY w1, w2, w3), x2 AS (SELECT w1, w2, sum(c) AS total, count(*) AS types FROM t3 GROUP BY w1, w2),
b2 AS (SELECT w2, w3, count(*) AS n FROM t3 GROUP BY w2, w3), x1 AS (SELECT w2, sum(n) AS total, count(*) AS types FROM b2 GROUP BY w2), u AS (SELECT w3, count(*) / (SELECT count(*) FROM b2)::DOUBLE AS p FROM b2 GROUP BY w3),
kn AS (SELECT t3.w1, t3.w2, t3.w3, c, greatest(c - {DISCOUNT}::DOUBLE, 0) / x2.total::DOUBLE + {DISCOUNT}::DOUBLE * x2.types / x2.total::DOUBLE * (greatest(b2.n - {DISCOUNT}::DOUBLE, 0) / x1.total::DOUBLE + {DISCOUNT}::DOUBLE * x1.types / x1.total::DOUBLE * u.p) AS p
  FROM t3 JOIN x2 USING (w1, w2) JOIN b2 ON b2.w2 = t3.w2 AND b2.w3 = t3.w3 JOIN x1 ON x1.w2 = t3.w2 JOIN u ON u.w3 = t3.w3)"""
