"""Column functions for text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import KNOTS, RATINGS, SUGGESTION_PATTERNS

SPACE = r"[ \t\n\r\f\x0B]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\r\f\x0b"))


def blank(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "") == ""


def syllables(word: Column) -> Column:
    """Vowel groups of each hyphenated part, one at least; ``word`` in lower case."""
    parts = F.split(word, "-")
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.greatest(F.lit(1), F.regexp_count(p, F.lit("[aeiouäöü]+"))))


def ends_with_any(word: Column, endings: Iterable[str]) -> Column:
    return word.rlike("(" + "|".join(endings) + ")$")


def starts_with_any(word: Column, beginnings: Iterable[str]) -> Column:
    return word.rlike("^(" + "|".join(beginnings) + ")")


def interpolated(raw: Column, measure: str) -> Column:
    """Piecewise linear score of a readability measure, clamped at both ends."""
    points = sorted(KNOTS[measure])
    score = F.when(raw <= points[0][0], F.lit(float(points[0][1])))
    for (r0, n0), (r1, n1) in zip(points, points[1:], strict=False):
        score = score.when(raw <= r1, F.lit(float(n0)) + (raw - float(r0)) / F.lit(float(r1) - float(r0)) * F.lit(float(n1 - n0)))
    return score.otherwise(F.lit(float(points[-1][1])))


def interpolated_sql(raw: str, measure: str) -> str:
    points = sorted(KNOTS[measure])
    whens = [f"WHEN {raw} <= {points[0][0]} THEN {float(points[0][1])}::DOUBLE"]
    whens += [f"WHEN {raw} <= {r1} THEN {float(n0)}::DOUBLE + ({raw} - {float(r0)}::DOUBLE) / {float(r1) - float(r0)!r}::DOUBLE * {float(n1 - n0)}::DOUBLE" for (r0, n0), (r1, n1) in zip(points, points[1:], strict=False)]
    return f"CASE {' '.join(whens)} ELSE {float(points[-1][1])}::DOUBLE END"


def round2(x: Column) -> Column:
    """Half up at two decimals, the same in every engine."""
    return F.floor(x * 100 + F.lit(0.5)).cast("double") / F.lit(100.0)


def rating(score: Column) -> Column:
    out = None
    for top, name in RATINGS:
        out = out.otherwise(F.lit(name)) if top is None else (F.when if out is None else out.when)(score < top, F.lit(name))
    return out


def first_quoted(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, '"([^"]+)"', 1), F.lit(""))


def quoted(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit('"([^"]+)"'), F.lit(1))


def suggestion(message: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in SUGGESTION_PATTERNS))


def problematic_text(message: Column) -> Column:
    """The first quoted part of a message, else what stands before its first period or comma, 50 characters at most."""
    return F.coalesce(first_quoted(message), F.substring(strip(F.element_at(F.split(message, "[.,]"), 1)), 1, 50))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
