"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, extract, langid, lines, mixing, neardup, pii, prefixes, quality, sharding, tokens, urls
from ._shared import table




def llm_shard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can say: all but the checksum."""
    return sharding.op3_shard(spark, sf_dir).drop("text_crc32")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's targets: a row for each source."""
    sizes = table(spark, sf_dir, "documents").select("source", mixing.word_count(F.col("text")).alias("size"))
    per = mixing.targets(sizes)
    return per.select("source", "source_size", "n_docs", F.round(F.col("target") * 1000).cast("long").alias("target_thousandths"))


def llm_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's counts of the base kinds."""
    return pii.op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def llm_quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's base figures and verdict."""
    return quality.op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: Levels by recursion: each round, sources above their cap are set to it and the rest is shared anew.
MIX_TARGETS = r"""
WITH RECURSIVE per AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size, count(*) AS n_docs FROM documents GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM per),
lv AS (SELECT 0 AS k, (SELECT sum(source_size) FROM w) / (SELECT sum(w) FROM w)::DOUBLE AS level
  UNION ALL SELECT k + 1, ((SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(3 * source_size), 0) FROM w WHERE 3 * source_size < w * level)) / (SELECT sum(w) FROM w WHERE 3 * source_size >= w * level)::DOUBLE FROM lv WHERE k < 30)
SELECT source, source_size, n_docs, CAST(round(least(w * (SELECT level FROM lv WHERE k = 30), 3 * source_size) * 1000) AS BIGINT) AS target_thousandths FROM w
"""

PII_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, len(email) AS n_email, len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(x)), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substring(reverse(x), k, 1) AS INTEGER)
    ELSE CAST(substring(reverse(x), k, 1) AS INTEGER) * 2 - CASE WHEN CAST(substring(reverse(x), k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 10 AND 15)) AS n_phone FROM m
"""

QUALITY_FIGURES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_mix": mixing.op2_mix,
        "op3_shard": sharding.op3_shard,
        "op4_language": langid.op4_language,
        "op5_tokens": tokens.op5_tokens,
        "op6_urls": urls.op6_urls,
        "op7_neardup": neardup.op7_neardup,
        "op8_lines": lines.op8_lines,
        "op9_pii": pii.op9_pii,
        "op10_quality": quality.op10_quality,
        "op11_codes": codes.op11_codes,
        "op12_prefixes": prefixes.op12_prefixes,
        "op13_main_text": extract.op13_main_text,
        "llm_shard_places": llm_shard_places,
        "llm_mix_targets": llm_mix_targets,
        "llm_pii_counts": llm_pii_counts,
        "llm_quality_figures": llm_quality_figures,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op6_urls": urls.ORACLE,
        "op7_neardup": neardup.ORACLE,
        "op11_codes": codes.ORACLE,
        "op12_prefixes": prefixes.ORACLE,
        "llm_shard_places": sharding.ORACLE,
        "llm_mix_targets": MIX_TARGETS,
        "llm_pii_counts": PII_COUNTS,
        "llm_quality_figures": QUALITY_FIGURES,
    }
