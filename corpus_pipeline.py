"""From raw documents to token files: quality, near duplicates, decontamination, mixing, tokens.

Every stage but the last returns the columns of ``documents``; each is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucidtext.llm._shared import settled, table
from lucidtext.llm.decontaminate import stage_decontaminate
from lucidtext.llm.mixing import stage_mix
from lucidtext.llm.neardup import stage_neardup
from lucidtext.llm.quality import stage_quality
from lucidtext.llm.tokens import stage_tokens

STAGES = [
    ("quality", stage_quality),
    ("neardup", stage_neardup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("tokens", stage_tokens),
]

#: Compression ratios, hashed chances and a tokenizer's merges aren't SQL; tests run all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what a stage was made from is deleted once the stage is written."""

    def after(k: int) -> DataFrame:
        if not k:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[k - 1]
        return settled(lambda: stage(spark, after(k - 1), sf_dir), name)

    return after(len(STAGES))
