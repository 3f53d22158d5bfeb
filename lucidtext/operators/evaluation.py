"""Evaluation runs: matrix, resume, summary, metrics on given predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def length_bin(words: Column) -> Column:
    return F.when(words <= 40, "short").when(words <= 100, "medium").otherwise("long")


def run_matrix(models: DataFrame, texts: DataFrame) -> DataFrame:
    """Every model with every text: the planned runs. Both are lists of what an evaluation names."""
    return models.crossJoin(texts)


def remaining(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done, ["provider", "model", "text_id"], "left_anti")


def summary(runs: DataFrame) -> DataFrame:
    """One row for each (provider, model, tier, length): averages over valid or known values only."""
    valid = F.when(F.col("final_violations") >= 0, F.col("final_violations").cast("double"))
    return runs.groupBy("provider", "model", "tier", "length_bin").agg(
        F.count(F.lit(1)).alias("n"),
        T.round2(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0))).alias("success_rate"),
        T.round2(F.coalesce(F.avg(valid), F.lit(0.0))).alias("avg_violations"),
        T.round2(F.avg(F.col("iterations").cast("double"))).alias("avg_iterations"),
        T.round2(F.avg("seconds")).alias("avg_seconds"),
        T.round2(F.avg(F.col("faithfulness").cast("double"))).alias("avg_faithfulness"),
        T.round2(F.avg("hix")).alias("avg_hix"),
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support from rows of (label, pred)."""
    both = predictions.select(F.explode(F.array(F.struct(F.col("label").alias("k"), (F.col("label") == F.col("pred")).alias("hit"), F.lit(True).alias("true")), F.struct(F.col("pred").alias("k"), (F.col("label") == F.col("pred")).alias("hit"), F.lit(False).alias("true")))).alias("x"))
    return both.groupBy(F.col("x.k").alias("label")).agg(
        F.count_if(F.col("x.true") & F.col("x.hit")).alias("tp"),
        F.count_if(~F.col("x.true") & ~F.col("x.hit")).alias("fp"),
        F.count_if(F.col("x.true") & ~F.col("x.hit")).alias("fn"),
        F.count_if("x.true").alias("support"),
    )


def scores(c: DataFrame) -> DataFrame:
    """precision, recall and f1 of each label; 0 where undefined."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    x = c.withColumn("precision", p).withColumn("recall", r)
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def weighted_scores(c: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, f1."""
    s = scores(c)
    n = F.sum("support")
    return s.agg((F.sum("tp") / n).alias("accuracy"), *((F.sum(F.col(m) * F.col("support")) / n).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")))
