"""Readers of the formats that corpora, fixtures and records come in. All give DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """rule, name, expected, description, text of each *.txt under ``folder``; header lines begin with #."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.input_file_name()
    head = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("rule"),
        F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("name"),
        F.lower(head(r"(?im)^#\s*expected:[ \t]*([a-z]+)")).alias("expected"),
        head(r"(?im)^#\s*description:[ \t]*([^\n]+)").alias("description"),
        T.strip(F.regexp_replace("value", r"(?m)^#[^\n]*$", "")).alias("text"),
    )


def discovered(spark: SparkSession, folder: str, rule_file: str, training_file: str) -> DataFrame:
    """rule, trainable: folders that hold a rule's file, and whether they hold a training configuration, too."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("rule"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return names.groupBy("rule").agg(F.bool_or(F.col("file") == training_file).alias("trainable"), F.bool_or(F.col("file") == rule_file).alias("is_rule")).where("is_rule").drop("is_rule")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a line each; lines that aren't records are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of one JSON array that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def statements_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated rows whose fields may hold commas and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def line_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~T.blank(F.col("value")))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, sha256 of each file."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``manifest`` (name, sha256) with ok: the file is there and its checksum agrees."""
    have = checksums(spark, folder).select("name", F.col("sha256").alias("found"))
    return manifest.join(have, "name", "left").withColumn("ok", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)))
