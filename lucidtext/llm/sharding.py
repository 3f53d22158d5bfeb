"""Shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; with one more
shard, rows move only into the new one, and no ring table is kept. Slots number the
rows of a shard without gaps: shards are cut into chunks of equal hash range, counted
in one aggregation, and numbered chunk by chunk from the counts before them, so that
no task holds a whole shard. A chunk with too many different rows, as of a key that
very many rows have, is cut further by a hash of the rows themselves.

A null key hashes like a fixed number of its own. Rows that agree in everything the
order looks at are counted before they are dealt out and numbered one after the
other; null texts have no bytes. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import few, table, written
from ._words import mix

SHARDS = 24
#: Rows of a chunk of a shard, about.
CHUNK_ROWS = 20_000


def keyed(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit keys evenly."""
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key. For a given key, raising ``shards`` by one keeps the shard or gives the new one."""
    key = keys.astype(np.uint64).copy()
    shard = np.full(len(key), -1, np.int64)
    nxt = np.zeros(len(key), np.int64)
    on = np.arange(len(key))
    while len(on):
        shard[on] = nxt[on]
        key[on] = key[on] * np.uint64(2862933555777941757) + np.uint64(1)
        nxt[on] = ((shard[on] + 1) * (float(1 << 31) / ((key[on] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = on[nxt[on] < shards]
    return shard


def placed(shards: int):
    """A column function: key -> struct(h, shard, grown_shard)."""

    @F.arrow_udf("h long, shard int, grown_shard int")
    def place(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        h = keyed(ids.fill_null(0).to_numpy())
        h[~known] = keyed(np.zeros(1, np.int64), seed=1)[0]
        columns = [pa.array(h.view(np.int64)), pa.array(jump(h, shards), pa.int32()), pa.array(jump(h, shards + 1), pa.int32())]
        return pa.StructArray.from_arrays(columns, names=["h", "shard", "grown_shard"])

    return place


def shard(rows: DataFrame, key: str, shards: int, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``key`` (a long), ``order`` and shard, grown_shard, slot for each row; slots follow the chunk, the key's hash, the key, then ``order``."""
    cols = [key, *order]
    given = rows.select(*cols).withColumn("_p", placed(shards)(key)).select(*cols, "_p.*")
    # equal rows are counted in place, so that a key with very many rows stays small
    counted = written(given.groupBy(*cols, "h", "shard", "grown_shard").agg(F.count(F.lit(1)).alias("_n")), "counted")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    bits = max(0, min(20, (total // (shards * chunk_rows)).bit_length()))
    counted = counted.withColumn("_chunk", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    wide = counted.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > 8 * chunk_rows)
    wide = wide.select("shard", "_chunk", F.ceil(F.col("_many") / chunk_rows).alias("_cuts"))
    cut = F.pmod(F.xxhash64(*cols), F.coalesce("_cuts", F.lit(1)))
    counted = counted.join(few(wide, 3), ["shard", "_chunk"], "left").withColumn("_cut", cut).drop("_cuts")
    per_chunk = counted.groupBy("shard", "_chunk", "_cut").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_chunk", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select("shard", "_chunk", "_cut", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_chunk", "_cut").orderBy("h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    dealt = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["shard", "_chunk", "_cut"])
    first = F.col("_start") + F.col("_before")
    return dealt.withColumn("slot", F.explode(F.sequence(first, first + F.col("_n") - 1))).select(*cols, "shard", "grown_shard", "slot")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row. Null texts have no bytes (size 8); null ids share one key and so one shard; repeated rows get slots of their own; without documents no rows."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs, "doc_id", SHARDS, ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The jump loop as a recursive query over 128-bit numbers; slots by window.
ORACLE = """
WITH RECURSIVE k AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, text,
    (CAST(coalesce(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id IS NULL THEN 4354685564936845354 ELSE 11400714819323198485 END) % 18446744073709551616 AS x0 FROM documents
), m1 AS (SELECT *, CAST((x0 + 18446744073709551616) % 18446744073709551616 AS UBIGINT) AS x FROM k),
m2 AS (SELECT * EXCLUDE (x), CAST(CAST(xor(x, x >> 30) AS UHUGEINT) * 13787848793156543929 % 18446744073709551616 AS UBIGINT) AS x FROM m1),
m3 AS (SELECT * EXCLUDE (x), CAST(CAST(xor(x, x >> 27) AS UHUGEINT) * 10723151780598845931 % 18446744073709551616 AS UBIGINT) AS x FROM m2),
h AS (SELECT * EXCLUDE (x, x0), xor(x, x >> 31) AS h FROM m3),
j AS (
  SELECT DISTINCT h, n, h AS key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM h, (VALUES (24), (25)) t(n)
  UNION ALL
  SELECT h, n, key2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(key2 >> 33 AS DOUBLE) + 1))) AS BIGINT)
  FROM (SELECT *, CAST((CAST(key AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS UBIGINT) AS key2 FROM j WHERE j < n)
), s AS (SELECT h, CAST(max(b) FILTER (WHERE n = 24) AS INTEGER) AS shard, CAST(max(b) FILTER (WHERE n = 25) AS INTEGER) AS grown_shard FROM j GROUP BY h)
SELECT doc_id, CAST(size AS BIGINT) AS size, shard, grown_shard, 'key' AS law,
  row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END, doc_id, size) - 1 AS slot
FROM h JOIN s USING (h)
"""
