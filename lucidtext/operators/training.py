"""Dataset preparation: cleaning, label repair, splits, vocabularies, class weights, n-grams."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import lexicons as L
from ..functions import text as T


def normalized(text: Column) -> Column:
    """Plain replacements for typographic signs, in their order."""
    for old, new in L.NORMALIZATION:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def cleaned(line: Column, compose: bool = True) -> Column:
    """A corpus line without artifacts, control characters and doubled blanks."""
    x = normalized(F.regexp_replace(line, L.ARTIFACT, ""))
    x = nfkc(x) if compose else x
    x = F.regexp_replace(x, r"[\x00-\x1F\x7F-\x{9F}]", " ")
    return T.strip(F.regexp_replace(x, " +", " "))


def has_artifact(line: Column) -> Column:
    return line.rlike(L.ARTIFACT)


def repaired_bio(labels: Column) -> Column:
    """B after B or I becomes I: a run is one entity."""
    return F.transform(labels, lambda x, i: F.when(x.startswith("B-") & (i > 0) & F.get(labels, i - 1).rlike("^[BI]-"), F.concat(F.lit("I-"), F.substring(x, F.lit(3), F.length(x)))).otherwise(x))


def known_labels(labels: Column, allowed: list[str]) -> Column:
    return F.transform(labels, lambda x: F.when(x.isin(*allowed), x).otherwise("O"))


def vocabulary(rows: DataFrame, labels: str) -> DataFrame:
    """label, id: all labels of an array column in their order, from 0."""
    return rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias("v")).select(F.posexplode("v").alias("id", "label"))


def split_of(key: Column, train: int = 8, validation: int = 1) -> Column:
    """train, validation or test by the tenth that an id falls into: the same in every run."""
    part = F.pmod(key, F.lit(10))
    return F.when(part < train, "train").when(part < train + validation, "validation").otherwise("test")


def stratified(rows: DataFrame, label: str, key: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Splits of each label by rank of the key."""
    rank = F.percent_rank().over(Window.partitionBy(label).orderBy(key))
    return rows.withColumn("split", F.when(rank < train, "train").when(rank < train + validation, "validation").otherwise("test"))


def class_weights(counts: DataFrame) -> DataFrame:
    """N / (K * n) for each of K labels with n of all N rows."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def lm_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[.,!?]"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Padded n-grams of a token array, joined by blanks."""
    pad = F.concat(F.array_repeat(F.lit("<s>"), n - 1), tokens, F.array_repeat(F.lit("</s>"), n - 1))
    # n shifted copies side by side: an index into the array would compute it anew for each gram
    shifted = F.arrays_zip(*(F.slice(pad, F.lit(j + 1), F.size(pad) - n + 1).alias(f"w{j}") for j in range(n)))
    return F.transform(shifted, lambda z: F.concat_ws(" ", *(z[f"w{j}"] for j in range(n))))
