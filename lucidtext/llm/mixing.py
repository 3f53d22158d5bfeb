"""Mixing sources to target weights by pivotal dependent rounding, in SQL expressions only.

Each source's target is its share of all words by weight, at most ``MAX_COPIES``
times its own words; what that cuts off goes to the others by weight. A document's
expected copies are target / source size. The whole part is certain; the fractional
parts are rounded together: two documents of a source trade probability, weighed by
their words, at random and without changing either's expectation until one is 0 or 1.
The words a source takes in total thus stay put, but for the one document left last:
it is rounded to the nearer side, and settled documents are turned to make that good.

The trades run in a reduction tree: cells of about ``FAN`` documents by hash, then
cells of about ``FAN`` leftovers, and so on, so that no task sees a whole source. A
source ends at the level where it has one cell. Each cell sends some settled documents
up with its leftover, so that about ``FAN`` of a source that are taken once more, and as many
that aren't, are at hand there.
Chance comes from hashes of the documents, so reruns agree.

Sources are ranked by ranges of names, and the level at which targets stand is found by
sums over all sources, again and again until no further one reaches its cap: no task
and no window sees all sources.

Null and empty texts have no words: they take none. A null source is a source. Rows
that repeat are counted first, then dealt with one by one, each with a chance of its
own, so they spread over the cells however many they are. With no words at all, every
target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import columns, few, table, written

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
FAN = 128
#: Up to so many sources their figures are sent to all executors.
SENT_SOURCES = 10_000


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text, without a row or an array element for a word."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def _ranked(per: DataFrame, by: str) -> DataFrame:
    """``per`` with _rank: from 0, in the order of ``by``, null last. Ranges of names are numbered on their own."""
    order = F.col(by).asc_nulls_last()
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(per.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dict(dealt.groupBy("_part").agg(F.count(F.lit(1))).collect())  # a row for each partition
    starts, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_rank", F.element_at(F.array(*(F.lit(x).cast("long") for x in starts or [0])), F.col("_part") + 1) + inside).drop("_part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target. ``sizes``: source and size of each document. One row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    per = written(_ranked(per, "source").withColumn("w", weight).withColumn("cap", F.lit(max_copies) * F.col("source_size")), "sources")
    total, w = per.agg(F.sum("source_size"), F.sum("w")).first()
    capped = (0, 0)  # sums of the caps and weights of the sources that have reached theirs
    level = 0.0
    while total:  # ends: each round more sources reach their cap, or it is the last
        left, rest = total - capped[0], w - capped[1]
        if rest <= 0:
            level = None
            break
        level = left / rest
        # in whole numbers: cap * rest < w * left says that the source's cap lies below the level
        full = F.col("cap").cast("decimal(38,0)") * F.lit(rest).cast("decimal(19,0)") < F.col("w").cast("decimal(19,0)") * F.lit(left).cast("decimal(38,0)")
        now = per.where(full).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if tuple(now) == tuple(capped):
            break
        capped = tuple(now)
    cap = F.col("cap").cast("double")
    share = cap if level is None else F.least(F.lit(level) * F.col("w"), cap)
    return per.select("source", "source_size", "n_docs", share.alias("target"))


_GAIN = "least((1 - acc.cur.p) * acc.cur.size, x.p * x.size)"
_LOSS = "least(acc.cur.p * acc.cur.size, (1 - x.p) * x.size)"
_CHANCE = "pmod(xxhash64(acc.cur.k, x.k, acc.cur.size, x.size), 9007199254740992) / 9007199254740992D"
_UNIT = "struct<k:bigint,doc_id:bigint,size:bigint,whole:bigint,p:double>"


def _unit(of: str, p: str) -> str:
    return f"named_struct('k', {of}.k, 'doc_id', {of}.doc_id, 'size', {of}.size, 'whole', {of}.whole, 'p', {p})"


#: Trade between the one carried on (acc.cur) and the next (x); ``up``: the carried one gains.
_TRADE = f"""aggregate(array_sort(units),
  named_struct('cur', CAST(NULL AS {_UNIT}), 'done', CAST(array() AS array<{_UNIT}>)),
  (acc, x) -> CASE
    WHEN acc.cur IS NULL THEN named_struct('cur', x, 'done', acc.done)
    WHEN {_CHANCE} * ({_GAIN} + {_LOSS}) < {_LOSS} THEN
      CASE WHEN (1 - acc.cur.p) * acc.cur.size <= x.p * x.size
        THEN named_struct('cur', {_unit('x', f'greatest(0D, x.p - {_GAIN} / x.size)')}, 'done', concat(acc.done, array({_unit('acc.cur', '1D')})))
        ELSE named_struct('cur', {_unit('acc.cur', f'least(1D, acc.cur.p + {_GAIN} / acc.cur.size)')}, 'done', concat(acc.done, array({_unit('x', '0D')}))) END
    ELSE
      CASE WHEN acc.cur.p * acc.cur.size <= (1 - x.p) * x.size
        THEN named_struct('cur', {_unit('x', f'least(1D, x.p + {_LOSS} / x.size)')}, 'done', concat(acc.done, array({_unit('acc.cur', '0D')})))
        ELSE named_struct('cur', {_unit('acc.cur', f'greatest(0D, acc.cur.p - {_LOSS} / acc.cur.size)')}, 'done', concat(acc.done, array({_unit('x', '1D')}))) END
  END)"""


#: The last leftover goes to its nearer side; what that adds or takes off in words is made good by
#: turning the settled documents at hand, from the longest that fits on down.
_LAST = f"""aggregate(reverse(array_sort(transform(done, u -> named_struct('size', u.size, 'k', u.k, 'unit', u)))),
  named_struct('e', (round(cur.p) - cur.p) * cur.size, 'done', array({_unit('cur', 'round(cur.p)')})),
  (acc, x) -> CASE
    WHEN x.unit.p >= 0.5D AND x.size <= acc.e THEN named_struct('e', acc.e - x.size, 'done', concat(acc.done, array({_unit('x.unit', '0D')})))
    WHEN x.unit.p < 0.5D AND x.size <= -acc.e THEN named_struct('e', acc.e + x.size, 'done', concat(acc.done, array({_unit('x.unit', '1D')})))
    ELSE named_struct('e', acc.e, 'done', concat(acc.done, array(x.unit))) END).done"""


#: Rows that repeat are dealt out in chunks of so many.
CHUNK_ROWS = 1_000_000


def _told_apart(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size and k, a hash of its own for each row: rows that are equal are counted and numbered."""
    counted = written(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "counted")
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_ROWS))))
    if (counted.agg(F.max("n")).first()[0] or 0) > CHUNK_ROWS:
        chunks = chunks.repartition("doc_id", "source", "size", "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK_ROWS) - 1
    each = chunks.select("doc_id", "source", "size", F.explode(F.sequence(F.col("chunk") * CHUNK_ROWS, last)).alias("i"))
    return each.select("doc_id", "source", "size", F.xxhash64("doc_id", "size", "i").alias("k"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source, source_size, target, copies of each row of ``sizes`` (doc_id long, source, size long)."""
    per = written(targets(sizes, weights, max_copies), "targets")
    n, most = per.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    side = F.broadcast(per) if n <= SENT_SOURCES else per
    s = _told_apart(sizes.select("doc_id", "source", "size")).alias("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = (
        s.join(side.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.doc_id", "s.source", "s.size", "t.n_docs", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), "s.k")
    )
    still = (F.col("p") <= 0) | (F.col("size") == 0)
    # cells of the lowest level; each level above has FAN times fewer
    cells = F.ceil(F.col("n_docs") / FAN)
    unit = F.struct("k", "doc_id", "size", "whole", "p")
    at = rated.where(~still).select("source", cells.alias("cells"), F.pmod("k", cells).alias("cell"), unit.alias("unit"), F.expr(f"CAST(array() AS array<{_UNIT}>)").alias("spare"))
    done = [rated.where(still).select("source", "doc_id", "size", F.col("whole").alias("copies"))]
    left = most or 0
    while left:
        left = -(-left // FAN)
        cell = at.groupBy("source", "cells", "cell").agg(F.collect_list("unit").alias("units"), F.flatten(F.collect_list("spare")).alias("spare"))
        cell = cell.select("source", "cells", "cell", "spare", F.expr(_TRADE).alias("r"))
        # documents first, leftovers of lower levels after them: these tend to be long
        cell = written(cell.select("source", "cells", "cell", "r.cur", F.concat("spare", "r.done").alias("done")), "trades")
        each = F.greatest(F.lit(1), F.floor(F.lit(FAN) / F.col("cells"))).cast("int")
        sides = [F.filter("done", lambda u: u["p"] < 0.5), F.filter("done", lambda u: u["p"] >= 0.5)]
        spare = F.concat(*(F.slice(x, F.lit(1), each) for x in sides))
        units = F.when(F.col("cells") <= 1, F.expr(_LAST)).otherwise(F.concat(*(F.slice(x, each + 1, F.size("done")) for x in sides)))
        settled = cell.select("source", F.explode(units).alias("u"))
        done.append(settled.select("source", "u.doc_id", "u.size", (F.col("u.whole") + F.round("u.p")).cast("long").alias("copies")))
        if left <= 1:
            break
        at = cell.where("cells > 1").select("source", F.ceil(F.col("cells") / FAN).alias("cells"), F.floor(F.col("cell") / FAN).alias("cell"), F.col("cur").alias("unit"), spare.alias("spare"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    o = out.alias("o")
    return o.join(side.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.doc_id", "o.size", "o.source", "t.source_size", "t.target", "o.copies")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row. Null texts and those without words take 0; a null source is a source of its own, last in order; repeated rows are told apart by number alone; without documents no rows."""
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    mixed = mix(written(sizes, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; columns stay.

    Rows of one doc_id, source and size share the sum of their copies evenly; what is left over
    goes to one more copy each of as many of them. Texts without words aren't taken.
    """
    sized = docs.select(F.struct(*columns(docs)).alias("_row"))
    own = (F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.source").alias("source"), word_count(F.col("_row.text")).alias("size"))
    mixed = mix(written(sized.select(*own), "sizes"))
    # copies belong to (doc_id, source, size); rows that share these are told apart by their number
    t = written(mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "takes").alias("t")
    row = sized.select("_row", *(c.alias(f"_{n}") for c, n in zip(own, ("id", "source", "size"), strict=True)))
    cond = F.col("_id").eqNullSafe(F.col("t.doc_id")) & F.col("_source").eqNullSafe(F.col("t.source")) & (F.col("_size") == F.col("t.size"))
    taken = t.where("copies > 0")
    # a source's name is as many values as it has eight bytes, and one
    single = few(taken.where("rows = 1").drop("rows"), 4 + F.floor(F.octet_length(F.coalesce("source", F.lit(""))) / 8))
    one = row.join(single.alias("t"), cond).select("_row", F.col("t.copies").alias("n"))
    many = taken.where("rows > 1")
    if not many.isEmpty():
        key = ["_id", "_source", "_size"]
        several = written(row.join(many.alias("t"), cond).select("_row", *key, "t.copies", "t.rows").withColumn("_part", F.spark_partition_id()), "several")
        # numbered within each partition, then from what the partitions before hold: no task has all rows of a key
        per_part = several.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_c"))
        start = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = per_part.select(*(F.col(k).alias(f"s{k}") for k in key), F.col("_part").alias("s_part"), start.alias("_start"))
        same = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in key] + [F.col("_part") == F.col("s_part")]
        rank = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.xxhash64("_row.text"))) + F.col("_start")
        several = several.join(starts, same).withColumn("_rank", rank)
        one = one.unionByName(several.select("_row", (F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("_rank") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).alias("n")))
    return one.where("n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("_row.*")
