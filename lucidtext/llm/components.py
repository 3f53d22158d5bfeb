"""Connected components of an edge table, by contraction.

Each round every node takes the neighbour (or itself) that comes first in hash order,
edges are renamed to these and those within one node go. In hash order the rounds
needed grow with the logarithm of the nodes. Edges and the map from nodes to what
they have become are written after each round; nothing is gathered on the driver but
whether edges are left. A node with very many edges is counted down by partial
aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node of its component) of all nodes with an edge. Null ends and loops don't count."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = left.select("a").unionByName(left.select(F.col("b").alias("a"))).distinct()
    names = both.select(F.col("a").alias("node"), F.col("a").alias("now"))
    while not left.isEmpty():  # of two ends, at least the one later in hash order goes: names get fewer each round
        two = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        best = two.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(F.col("m"), rank("a")).getField("n").alias("to"))
        best = written(best, "steps")
        x, y = best.select("a", F.col("to").alias("ta")), best.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = left.join(x, "a").join(y, "b").where("ta <> tb")
        left = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        names = names.join(best.select(F.col("a").alias("now"), "to"), "now", "left").select("node", F.coalesce("to", "now").alias("now"))
        names = written(names, "names")
    least = names.groupBy("now").agg(F.min("node").alias("component"))
    return names.join(least, "now").select("node", "component")
