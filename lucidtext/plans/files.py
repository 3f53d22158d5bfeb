"""Queries that go through files or a stream: written to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, training
from ..sources import readers, sinks
from ..streaming import pipeline
from .registry import query, table


@query("snk2_jsonl_round_trip", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.shared_folder(spark)
    sinks.append_jsonl(table(spark, sf_dir, "conversations"), at)
    return readers.jsonl(spark, at, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("src8_csv_round_trip", "SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents")
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.shared_folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text").write.option("header", True).option("quote", '"').option("escape", '"').csv(at)
    rows = readers.statements_csv(spark, at, "doc_id long, lang string, n_chars long, text string")
    return rows.select("doc_id", "lang", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("snk5_split_files", "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels GROUP BY split")
def snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.shared_folder(spark)
    sinks.split_csvs(table(spark, sf_dir, "labels").withColumn("split", training.split_of(F.col("doc_id"))), at)
    rows = spark.read.schema("doc_id long, quality int, toxic int, split string").option("header", True).csv(at)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("snk9_ngram_tables", r"""WITH t AS (SELECT regexp_extract_all(lower(text), '\p{L}+|[.,!?]') AS w FROM documents), u AS (SELECT list_concat(['<s>'], w, ['</s>']) AS w FROM t), v AS (SELECT list_concat(['<s>', '<s>'], w, ['</s>', '</s>']) AS w FROM t)
SELECT 1 AS n, count(DISTINCT g) AS grams FROM (SELECT unnest(w) AS g FROM t) UNION ALL SELECT 2, count(DISTINCT g) FROM (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM u) UNION ALL SELECT 3, count(DISTINCT g) FROM (SELECT unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM v)""")
def snk9(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.shared_folder(spark)
    sinks.ngram_tables(table(spark, sf_dir, "documents"), at, order=3)
    return spark.read.option("recursiveFileLookup", True).schema("gram string, n long").parquet(at).select(F.regexp_extract(F.input_file_name(), "/n=([0-9]+)/", 1).cast("int").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("grams"))


_SENTENCE_HITS = " UNION ALL ".join(rules.sentence_rule_sql(*x) for x in rules.SENTENCE_RULES)


@query("str3_document_stream", f"WITH {rules.FEATURES_SQL} SELECT rule, count(*) AS n FROM ({_SENTENCE_HITS}) GROUP BY rule")
def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence violations of documents read as a stream, once through what is there."""
    at = sinks.shared_folder(spark)
    table(spark, sf_dir, "documents").write.parquet(f"{at}/in")
    found = pipeline.sentence_violations(pipeline.document_stream(spark, f"{at}/in"))
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, sent_no int, rule string, message string").parquet(f"{at}/out").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("str1_stream_requests", "SELECT DISTINCT sha256(user_id || chr(31) || event_type) AS request FROM events")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests read as a stream; of equal ones within the watermark the first goes through. What is there is one batch, so each request comes once."""
    at = sinks.shared_folder(spark)
    schema = "ts timestamp, request_hash string"
    request = F.sha2(F.concat_ws("\x1f", F.col("user_id").cast("string"), "event_type"), 256)
    table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), request.alias("request_hash")).write.parquet(f"{at}/in")
    found = pipeline.coalesced(spark.readStream.schema(schema).parquet(f"{at}/in"))
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out").select(F.col("request_hash").alias("request"))


@query("str2_failure_triggers", "SELECT event_type AS key, CAST(unnest(generate_series(50, n, 50)) AS BIGINT) AS at FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def str2_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 50th event of a kind, told by a stream with state that reads its files one after the other."""
    at = sinks.shared_folder(spark)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"))
    events.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    told = pipeline.failure_triggers(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    told.awaitTermination()
    return spark.read.schema("key string, at bigint").parquet(f"{at}/out")
