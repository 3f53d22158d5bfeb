"""Documents as a stream: the rules row by row, coalescing of equal requests, failure counters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import rules
from ..operators.annotate import Annotated

#: Failures of one kind after which something is to happen.
EVERY = 50


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def sentence_violations(docs: DataFrame) -> DataFrame:
    """Violations of all sentence declarations: stateless, so streams and tables go through the same plan."""
    s = rules.sentence_features(Annotated(docs))
    hits = F.array(*(F.when(F.expr(rules.spark_sql(p)), F.struct(F.lit(r).alias("rule"), F.expr(rules.spark_sql(m)).alias("message"))) for r, p, m in rules.SENTENCE_RULES))
    return s.withColumn("hit", F.explode(F.array_compact(hits))).select("doc_id", "sent_no", "hit.rule", "hit.message")


def coalesced(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of equal requests (ts, request_hash) within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_hash"])


def failure_counts(violations: DataFrame) -> DataFrame:
    """Running counts by rule, for update or complete mode."""
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def failure_triggers(failures: DataFrame, every: int = EVERY) -> DataFrame:
    """key, at: a row each time the failures of a ``key`` have reached another multiple of ``every``, over all batches of a stream.

    The count of a key is its state. A partition counts its rows first, so a key with very many failures sends one row from each.
    A null key counts as a key of its own.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str | None] = Counter()
        for batch in batches:
            total.update(batch["key"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    def reached(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + int(sum(p["n"].sum() for p in parts))
        state.update((now,))
        at = range((before // every + 1) * every, now + 1, every)
        yield pd.DataFrame({"key": [key[0]] * len(at), "at": list(at)})

    each = failures.select(F.col("key").cast("string").alias("key")).mapInArrow(counted, "key string, n bigint")
    return each.groupBy("key").applyInPandasWithState(reached, "key string, at bigint", "n bigint", "append", "NoTimeout")
