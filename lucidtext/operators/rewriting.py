"""Rewriting sentence by sentence: stages propose, violations decide.

A sentence's weight is that of its own violations. Each round every sentence that still has weight gets one candidate
from the stage whose turn it is; a candidate takes its place if it is a real rewrite and weighs less. All sentences of all documents
go through a round together; a sentence rests once its weight is 0 or it has been refused as often as there are
stages. The states are written after each round that changes any, but the last.

Stages are column functions, text -> text; a model's can be a vectorised UDF. Null and blank texts have no sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.folders import dropped, through_folder
from . import annotate, planner, violations

Stage = Callable[[Column], Column]


def clauses_apart(text: Column) -> Column:
    """Main clauses joined by a conjunction become sentences."""
    return F.regexp_replace(text, r", (?:und|aber|denn|doch|oder) (\p{L})", ". $1")


def plain_words(text: Column) -> Column:
    """Foreign words give way to plainer ones."""
    pairs = F.create_map(*(F.lit(x) for w, plain, _, _ in L.FOREIGN_WORDS for x in (w, plain)))
    plainer = F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.coalesce(F.try_element_at(pairs, F.lower(F.regexp_replace(w, r"[.,!?;:]+$", ""))), F.regexp_replace(w, r"[.,!?;:]+$", "")), F.regexp_extract(w, r"([.,!?;:]*)$", 1))), " ")
    # few texts have such a word; in others nothing changes (a mark before a line's end might)
    some = F.exists(F.split(F.lower(text), "[ .,!?;:]+"), lambda w: w.isin([w for w, *_ in L.FOREIGN_WORDS]))
    return F.when(some | text.rlike(r"[\n\r\x85\u2028\u2029]"), plainer).otherwise(text)


def single_marks(text: Column) -> Column:
    """One sentence mark instead of several, blanks single."""
    return F.regexp_replace(F.regexp_replace(text, r"([.!?])[.!?]+", "$1"), r" +", " ")


STAGES: tuple[Stage, ...] = (clauses_apart, plain_words, single_marks)


#: Accepted sentences of so many characters in all are sent to all executors.
SENT_CHARS = 4_000_000


def refined(docs: DataFrame, stages: Sequence[Stage] = STAGES, rounds: int = 3) -> DataFrame:
    """doc_row, doc_id, idx, original, current, before, weighted, attempts, status of each sentence of ``docs`` (doc_id, a whole number, and text).

    Documents are numbered first (doc_row) and sentences as they are written with their weights (sid), so that rows that share a doc_id, or have none, stay
    apart. Sentences are cut and weighed where their document is read. In a round only candidates are weighed, and only those that take a place are written and joined.
    """
    spark = docs.sparkSession
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("doc_row"))
    each = numbered.select("doc_row", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(annotate.SENTENCE), F.lit(0))).alias("p", "piece"))
    s = each.select("doc_row", "doc_id", (F.col("p") + 1).alias("idx"), T.strip(F.col("piece")).alias("text")).where("text <> ''")
    about = (F.col("doc_row"), F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("idx").cast("int").alias("idx"))
    written = through_folder(violations.weights(s, ("doc_row", "doc_id", "idx")).select(F.monotonically_increasing_id().alias("sid"), *about, F.col("text").alias("original"), F.col("weighted").alias("before")), "states")
    states = written.withColumns({"current": F.col("original"), "weighted": F.col("before"), "attempts": F.lit(0)})
    for k in range(rounds):
        stage = stages[k % len(stages)]
        is_open = (F.col("weighted") > 0) & (F.col("attempts") < len(stages))
        # a stage runs once for a sentence: a filter isn't moved before explode
        asked = states.where(is_open).select("sid", F.col("weighted").alias("most"), "current", F.explode(F.array(T.strip(stage(F.col("current"))))).alias("text"))
        asked = asked.where((F.col("text") != F.col("current")) & ~planner.looks_lazy(F.col("text"), F.col("current")))
        good = violations.weights(asked, ("sid", "most")).where("weighted < most")
        good = through_folder(good.select("sid", F.col("text").alias("c_text"), F.col("weighted").alias("c_weighted")), "accepted")
        chars = good.agg(F.sum(F.length("c_text") + 1)).first()[0]
        if not chars:  # all open sentences are refused alike
            states = states.withColumn("attempts", F.col("attempts") + F.when(is_open, 1).otherwise(0))
            dropped(spark, good)
            continue
        tried = states.join(F.broadcast(good) if chars <= SENT_CHARS else good, "sid", "left")
        better = F.col("c_weighted").isNotNull()
        states = tried.select(
            "sid", "doc_row", "doc_id", "idx", "original", F.when(better, F.col("c_text")).otherwise(F.col("current")).alias("current"), "before",
            F.when(better, F.col("c_weighted")).otherwise(F.col("weighted")).alias("weighted"), (F.col("attempts") + F.when(is_open & ~better, 1).otherwise(0)).alias("attempts"),
        )
        if k < rounds - 1:
            now = through_folder(states, "states")
            dropped(spark, written, good)
            written = states = now
    status = F.when(F.col("weighted") == 0, "done").when(F.col("attempts") >= len(stages), "failed").otherwise("open")
    return states.select("doc_row", "doc_id", "idx", "original", "current", "before", "weighted", "attempts", status.alias("status"))


def rewritten(docs: DataFrame, stages: Sequence[Stage] = STAGES, rounds: int = 3) -> DataFrame:
    """doc_id, text, edits: the documents put together again, a row for each row of ``docs`` that has sentences."""
    return planner.reassembled(refined(docs, stages, rounds), ("doc_row", "doc_id")).drop("doc_row")
