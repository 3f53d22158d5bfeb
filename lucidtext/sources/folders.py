"""Folders that driver and executors share: tables written there end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the one that driver and executors share; on one machine alone, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lucidtext-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def through_folder(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here."""
    at = f"{shared_folder(df.sparkSession)}-{name}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shuffles_dropped(spark: SparkSession) -> None:
    """Delete what queries that have ended have shuffled: Spark does so once the driver has collected its garbage, which a driver with little to do rarely does by itself."""
    spark.sparkContext._jvm.System.gc()


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``through_folder`` has written and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for at in {file.rsplit("/", 1)[0] for t in tables for file in t.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
