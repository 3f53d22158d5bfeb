"""Joins that frequent keys don't slow down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it has more than this share of the rows: there are no more than so many.
FREQUENT = 10_000
#: A table of so few rows is sent as a whole; of a larger one, so many of the most frequent keys.
SENT_ROWS = 200_000


def looked_up(big: DataFrame, small: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """``big`` with the columns of ``small`` but ``rows``; rows of ``big`` without a partner have nulls.

    ``small`` has a row for each key, none of it null, and in ``rows`` how many rows of ``big`` have that key. It is sent to all executors if it is
    small; else its frequent keys are, about ``SENT_ROWS`` of them, and only the others' rows meet in a shuffle, so that no task gets a frequent key and
    few rows of ``big`` are moved. Both tables are read more than once.
    """
    found = small.agg(F.sum(rows).alias("total"), F.count(F.lit(1)).alias("n")).first()
    if found.n <= SENT_ROWS:
        return big.join(F.broadcast(small.drop(rows)), list(keys), "left")
    least = small.agg(F.percentile_approx(rows, 1 - SENT_ROWS / found.n)).first()[0]
    often = F.col(rows) > min(least, found.total // FREQUENT)
    hot = F.broadcast(small.where(often).drop(rows))
    rest = big.join(F.broadcast(small.where(often).select(*keys)), list(keys), "left_anti")
    return big.join(hot, list(keys)).unionByName(rest.join(small.where(~often).drop(rows), list(keys), "left"))
