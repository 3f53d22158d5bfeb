"""Readability index: four formulas and five measures of a document, each scored by interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .annotate import TOKENS_SQL, Annotated
from .findings import Wanted, findings

FORMULAS = ("amstad", "wiener", "smog", "lix")
MEASURES = ("asl", "asw", "pct_long", "pct_poly", "pct_mono")


_COUNTED = Wanted(
    counts=(("words", "kind = 'w'"), ("long", "kind = 'w' AND length(text) > 6"), ("poly", "kind = 'w' AND n_syll >= 3"), ("mono", "kind = 'w' AND n_syll = 1")),
    syllables="kind = 'w'",
    sentences=True,
)


def word_statistics(a: Annotated) -> DataFrame:
    """doc_id, words, sents, syll, chars over 6, syllables of 3 and more, of 1. Digits and punctuation don't count."""
    s = findings(a.docs, _COUNTED).where("what = 's'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sents"), F.sum("syll_counted").alias("syll"), *(F.sum(c).alias(c) for c, _ in _COUNTED.counts))
    both = a.docs.select("doc_id").join(s, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return both.select("doc_id", F.greatest(F.lit(1).cast("long"), F.coalesce("sents", zero)).alias("sents"), *(F.coalesce(c, zero).alias(c) for c in ("words", "syll", "long", "poly", "mono")))


def index(a: Annotated) -> DataFrame:
    """doc_id, raw and scored formulas and measures, formula_score, parameter_score, hix, rating."""
    s = word_statistics(a)
    words, sents = F.col("words").cast("double"), F.col("sents").cast("double")
    per = lambda c: F.lit(100.0) * F.col(c) / words
    some = F.col("words") > 0
    raw = {
        "asl": words / sents,
        "asw": F.col("syll") / words,
        "pct_long": per("long"),
        "pct_poly": per("poly"),
        "pct_mono": per("mono"),
    }
    s = s.select("*", *(F.when(some, x).alias(k) for k, x in raw.items()))
    formulas = {
        "amstad": F.lit(180.0) - F.col("asl") - F.lit(58.5) * F.col("asw"),
        "wiener": F.lit(0.1935) * F.col("pct_poly") + F.lit(0.1672) * F.col("asl") + F.lit(0.1297) * F.col("pct_long") - F.lit(0.0327) * F.col("pct_mono") - F.lit(0.875),
        "smog": F.lit(3.0) + F.sqrt(F.lit(30.0) * F.col("poly") / sents),
        "lix": F.col("asl") + F.col("pct_long"),
    }
    s = s.select("*", *(F.when(some, x).alias(k) for k, x in formulas.items()))
    s = s.select("doc_id", "words", "sents", *(T.round2(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in (*FORMULAS, *MEASURES)), *(F.when(some, T.round2(T.interpolated(F.col(m), m))).otherwise(0.0 if m in FORMULAS else 10.0).alias(f"{m}_score") for m in (*FORMULAS, *MEASURES)))
    mean = lambda ms: T.round2(sum((F.col(f"{m}_score") for m in ms[1:]), F.col(f"{ms[0]}_score")) / F.lit(float(len(ms))))
    s = s.withColumn("formula_score", mean(FORMULAS)).withColumn("parameter_score", mean(MEASURES))
    s = s.withColumn("hix", F.least(F.lit(20.0), F.greatest(F.lit(0.0), T.round2(F.col("formula_score") + F.col("parameter_score")))))
    return s.withColumn("rating", T.rating(F.col("hix")))


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE"


STATISTICS_SQL = (
    TOKENS_SQL
    + """, st AS (
  SELECT d.doc_id, greatest(1, coalesce(x.sents, 0)) AS sents, coalesce(w.words, 0) AS words, CAST(coalesce(w.syll, 0) AS BIGINT) AS syll, coalesce(w.long, 0) AS long, coalesce(w.poly, 0) AS poly, coalesce(w.mono, 0) AS mono
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS sents FROM sent GROUP BY doc_id) x ON x.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS words, sum(n_syll) AS syll, count(*) FILTER (WHERE length(text) > 6) AS long, count(*) FILTER (WHERE n_syll >= 3) AS poly, count(*) FILTER (WHERE n_syll = 1) AS mono FROM tok WHERE kind = 'w' GROUP BY doc_id) w ON w.doc_id = d.doc_id
)"""
)
INDEX_SQL = (
    "WITH "
    + STATISTICS_SQL
    + """, r AS (SELECT *, words::DOUBLE / sents::DOUBLE AS asl, syll / words::DOUBLE AS asw, 100.0::DOUBLE * long / words::DOUBLE AS pct_long, 100.0::DOUBLE * poly / words::DOUBLE AS pct_poly, 100.0::DOUBLE * mono / words::DOUBLE AS pct_mono FROM st),
f AS (SELECT *, 180.0::DOUBLE - asl - 58.5::DOUBLE * asw AS amstad, 0.1935::DOUBLE * pct_poly + 0.1672::DOUBLE * asl + 0.1297::DOUBLE * pct_long - 0.0327::DOUBLE * pct_mono - 0.875::DOUBLE AS wiener,
  3.0::DOUBLE + sqrt(30.0::DOUBLE * poly / sents::DOUBLE) AS smog, asl + pct_long AS lix FROM r),
g AS (SELECT doc_id, words, sents, """
    + ", ".join(f"CASE WHEN words > 0 THEN {_r2(m)} ELSE 0.0 END AS {m}" for m in (*FORMULAS, *MEASURES))
    + ", "
    + ", ".join(f"CASE WHEN words > 0 THEN {_r2(T.interpolated_sql(m, m))} ELSE {0.0 if m in FORMULAS else 10.0}::DOUBLE END AS {m}_score" for m in (*FORMULAS, *MEASURES))
    + f""" FROM f), h AS (SELECT *, {_r2("(amstad_score + wiener_score + smog_score + lix_score) / 4.0::DOUBLE")} AS formula_score, {_r2("(asl_score + asw_score + pct_long_score + pct_poly_score + pct_mono_score) / 5.0::DOUBLE")} AS parameter_score FROM g),
k AS (SELECT *, least(20.0, greatest(0.0, {_r2("formula_score + parameter_score")})) AS hix FROM h)
SELECT *, CASE WHEN hix < 5 THEN 'expert' WHEN hix < 10 THEN 'complex' WHEN hix < 15 THEN 'readable' WHEN hix < 16 THEN 'plain' WHEN hix < 18 THEN 'simple' ELSE 'easy' END AS rating FROM k"""
)
