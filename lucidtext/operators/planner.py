"""Sentence states of a rewrite: assignment of issues, priority, acceptance, reassembly."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import lexicons as L
from ..functions import text as T


def assigned(issues: DataFrame, sents: DataFrame) -> DataFrame:
    """Each issue (doc_id, ord, start, end) with the sentence it overlaps most; the earlier one of equals; issues outside all sentences go.

    The overlap join runs within a document; only the best sentence of each issue leaves the aggregation.
    """
    i, s = issues.alias("i"), sents.alias("s")
    overlap = F.least("i.end", "s.end_char") - F.greatest("i.start", "s.start_char")
    met = i.join(s, (F.col("i.doc_id") == F.col("s.doc_id")) & (F.col("i.start") < F.col("s.end_char")) & (F.col("i.end") > F.col("s.start_char")))
    best = met.groupBy("i.doc_id", "i.ord").agg(F.max(F.struct(overlap.alias("overlap"), (-F.col("s.sent_no")).alias("back"))).alias("m"))
    return best.select("doc_id", "ord", (-F.col("m.back")).alias("sent_no"), F.col("m.overlap").alias("overlap"))


def first_open(states: DataFrame) -> DataFrame:
    """The open sentence with violations of each document that comes first: most weight, fewest attempts, lowest index."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weighted"), "attempts", "idx"))
    return states.where("status = 'open' AND weighted > 0").withColumn("r", rank).where("r = 1").drop("r")


def neighbours(sents: DataFrame, k: int = 1, text: str = "text") -> DataFrame:
    """Sentences with the texts of up to ``k`` before and after, joined by line breaks."""
    w = Window.partitionBy("doc_id").orderBy("sent_no")
    return sents.withColumn("before", F.array_join(F.collect_list(text).over(w.rowsBetween(-k, -1)), "\n")).withColumn("after", F.array_join(F.collect_list(text).over(w.rowsBetween(1, k)), "\n"))


def reassembled(states: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``key``, text, edits: sentences stripped and joined by single spaces; how many differ from their original."""
    parts = states.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("idx", T.strip(F.col("current")).alias("t")))).alias("ts"),
        F.count_if(T.strip(F.col("current")) != T.strip(F.col("original"))).alias("edits"),
    )
    return parts.select(*key, F.array_join(F.filter(F.transform("ts", lambda x: x["t"]), lambda t: t != ""), " ").alias("text"), "edits")


def looks_lazy(candidate: Column, source: Column) -> Column:
    """A placeholder instead of a rewrite, or far shorter than its source."""
    c = T.strip(F.coalesce(candidate, F.lit("")))
    short = (F.length(source) > 0) & (F.length(c) < F.lit(L.MIN_LENGTH_RATIO) * F.length(T.strip(source)))
    return (c == "") | c.rlike("|".join(f"(?:{p})" for p in L.LAZY_PATTERNS)) | F.coalesce(short, F.lit(False))


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """2 * matches / total length, as difflib counts matches; 0 if either text is empty."""
    return pa.array([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def acceptable(candidate: Column, source: Column) -> Column:
    return ~looks_lazy(candidate, source) & (similarity(candidate, source) >= L.MIN_SIMILARITY)


def stop_reason(weighted: Column, target: int, faith: Column, seconds: Column, deadline: float) -> Column:
    """Why a run ends: it succeeded, ran out of time, or is to go on."""
    good = (weighted <= target) & (faith.isNull() | (faith >= 4))
    return F.when(good, "success").when(seconds >= deadline, "deadline").otherwise("continue")
