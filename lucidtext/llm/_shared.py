"""What the corpus operators share: the shared folder, written tables, batch limits.

Tables that cut lineage go to the folder in ``spark.checkpoint.dir``; a folder of
our own is made only where that setting is absent (tests on one machine).
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handed to a Python worker at once; a longer row comes alone.
BATCH_BYTES = 2 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lucidtext-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here. ``by``: a column whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For ``sweep``: what is written from now on."""
    return len(_written)


def sweep(since: int, until: int = -1) -> None:
    """Delete the tables written since ``mark`` gave ``since``, all but the last, or up to ``until``."""
    inside = _written[since:until]
    del _written[since:until]
    for spark, path in inside:
        _delete(spark, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, written; the tables that were written for it are deleted."""
    before = mark()
    out = written(make(), name)
    sweep(before)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the machine: a Python worker lives on through many stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: Input bytes for each partition of a shuffle that moves whole texts.
PART_BYTES = 64 << 20


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``: the session's number, and more if the input is larger than that many can hold."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # an unknown size is given as the largest number
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // PART_BYTES), 1 << 20))


#: Up to so many values are sent to all executors; more are joined by shuffle.
SENT_VALUES = 1_000_000


def few(df: DataFrame, weight: Column | int = 2) -> DataFrame:
    """``df`` to be sent to all executors if it holds few enough values of fixed size; ``weight``: those of a row."""
    total = df.agg(F.sum(weight if isinstance(weight, Column) else F.lit(weight))).first()[0] or 0
    return F.broadcast(df) if total <= SENT_VALUES else df


#: A key is frequent if it has more than this share of the rows; there are no more than so many of them.
FREQUENT = 10_000


def looked_up(big: DataFrame, small: DataFrame, key: str, rows: str, weight: int) -> DataFrame:
    """``big`` with the columns of ``small``, which has one row for each ``key`` of ``big`` and, in ``rows``, how many rows of ``big`` have it.

    A small table is sent to all executors as a whole. Of a larger one the frequent keys are, at most ``FREQUENT``; their rows take random
    keys in the join by shuffle, so that no task gets a frequent one.
    """
    total = small.agg(F.sum(rows), F.count(F.lit(1))).first()
    if (total[1] or 0) * weight <= SENT_VALUES:
        return big.join(F.broadcast(small.drop(rows)), key)
    values = [c for c in small.columns if c not in (key, rows)]
    hot = small.where(F.col(rows) > total[0] // FREQUENT).select(F.col(key).alias("_hot"), F.struct(*values).alias("_h"))
    cold = small.where(F.col(rows) <= total[0] // FREQUENT).select(F.lit(False).alias("_spread"), F.col(key).cast("string").alias("_key"), F.struct(*values).alias("_c"))
    found = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    spread = F.col("_hot").isNotNull()
    found = found.withColumns({"_spread": spread, "_key": F.when(spread, F.pmod(F.xxhash64(*big.columns), F.lit(1 << 20)).cast("string")).otherwise(F.col(key).cast("string"))})
    found = found.join(cold, ["_spread", "_key"], "left")
    return found.select(*big.columns, *(F.coalesce(F.col("_h")[v], F.col("_c")[v]).alias(v) for v in values))


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
