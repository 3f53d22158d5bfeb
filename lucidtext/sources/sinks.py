"""Writers: records, summaries, cleaned corpora, splits, n-gram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import language_model, training
from .folders import dropped, shared_folder, through_folder  # noqa: F401


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, through the file system that Spark uses for the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def promote(spark: SparkSession, staged: str, live: str, stamp: str) -> str | None:
    """What is staged becomes live; what was live stays beside it under a stamp. Folders are renamed, so readers see one or the other."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(live).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(staged)):
        raise FileNotFoundError(staged)
    kept = None
    if fs.exists(path(live)):
        kept = f"{live}.{stamp}"
        fs.rename(path(live), path(kept))
    fs.rename(path(staged), path(live))
    return kept


def append_jsonl(records: DataFrame, path: str) -> None:
    """Add records; a run that fails leaves the earlier ones as they are."""
    records.write.mode("append").json(path)


def summary_csv(rows: DataFrame, path: str) -> None:
    """A summary (a row for each group) as one file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cleaned_corpus(lines: DataFrame, path: str) -> None:
    """Cleaned lines of ``lines`` (value), those that are left empty left out."""
    lines.select(training.cleaned(F.col("value")).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def split_csvs(rows: DataFrame, path: str) -> None:
    """A folder for each value of ``split``."""
    rows.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def ngram_tables(docs: DataFrame, path: str, order: int = 3) -> None:
    """Counts of all n-grams up to ``order`` as Parquet, by n."""
    for n in range(1, order + 1):
        language_model.gram_counts(docs, n).withColumnRenamed("g", "gram").write.mode("overwrite").parquet(f"{path}/n={n}")
