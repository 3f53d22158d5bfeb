"""Queries: annotation, the eighteen rules, and what is made of their union, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import annotate, morphology, readability, rules, violations
from ..operators.annotate import Annotated
from .registry import query, table


def corpus(spark: SparkSession, sf_dir: str) -> Annotated:
    return Annotated(table(spark, sf_dir, "documents"))


@query("tok1_tokens", f"WITH {annotate.TOKENS_SQL} SELECT doc_id, sent_no, i, t_start, t_end, text, lower, kind, n_syll, prev1, next1, next2 FROM tok")
def tok1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).tokens


@query("tok1_analyses")
def tok1_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag and lemma of every token; transitions counted over all documents. (Tests hold decoding against all sequences.)"""
    docs = table(spark, sf_dir, "documents")
    return morphology.analyses(docs, morphology.counted(docs))


@query("r14_genitive_kinds")
def r14_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genitives by what governs them."""
    return morphology.governed(table(spark, sf_dir, "documents"), rules=("genitiv",)).select("doc_id", "sent_no", "t_start", "t_end", "term", "kind")


@query("r15_subjunctive_classes")
def r15_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjunctives by mood and function."""
    return morphology.governed(table(spark, sf_dir, "documents"), rules=("konjunktiv",)).select("doc_id", "sent_no", "t_start", "t_end", "term", "kind", "function")


@query("tok2_sentences", f"WITH {annotate.SENTENCES_SQL} SELECT * FROM sent")
def tok2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).sentences


@query("tok8_real_words", f"WITH {annotate.TOKENS_SQL} SELECT doc_id, sent_no, count(*) FILTER (WHERE kind <> 'p') AS n_words FROM tok GROUP BY doc_id, sent_no")
def tok8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).tokens.groupBy("doc_id", "sent_no").agg(F.count_if(F.col("kind") != "p").alias("n_words"))


@query("tok9_word_filter", f"WITH {annotate.TOKENS_SQL} SELECT doc_id, lower, count(*) AS n, max(n_syll) AS n_syll, max(length(text)) AS n_chars FROM tok WHERE kind = 'w' GROUP BY doc_id, lower")
def tok9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).tokens.where("kind = 'w'").groupBy("doc_id", "lower").agg(F.count(F.lit(1)).alias("n"), F.max("n_syll").alias("n_syll"), F.max(F.length("text")).alias("n_chars"))


@query("agg3_word_statistics", f"WITH {readability.STATISTICS_SQL} SELECT * FROM st")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.word_statistics(corpus(spark, sf_dir))


@query("hix_index", readability.INDEX_SQL)
def hix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.index(corpus(spark, sf_dir))


def _features_columns() -> str:
    return "doc_id, sent_no, start_char, end_char, text, " + ", ".join(rules.FEATURES) + ", syll_counted, n_passive, n_paren, n_split, last_token, joined, long_flags"


@query("aux7_sentence_metrics", f"WITH {rules.FEATURES_SQL} SELECT {_features_columns()} FROM sf")
def aux7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sentence_features(corpus(spark, sf_dir))


_NUMBERS = {
    "satzlaenge": 1, "nebensaetze": 2, "passiv_erkennung": 3, "fremdwoerter": 4, "komposita": 5, "kurze_woerter": 6, "komplexitaet": 7, "negationen": 8, "redewendungen": 9,
    "personalpronomen": 10, "zahlwoerter": 11, "abkuerzungen": 12, "interpunktion": 13, "genitiv": 14, "konjunktiv": 15, "perplexity_saetze": 16, "mehrere_aussagen": 17, "synonyme": 18,
}
for _rule, _n in _NUMBERS.items():
    query(f"r{_n:02d}_{_rule}", rules.rule_sql(_rule))(lambda spark, sf_dir, rule=_rule: rules.check_rule(corpus(spark, sf_dir), rule))


@query("set1_all_violations", f"{rules.violations_sql()} SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v GROUP BY rule")
def set1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.violations(corpus(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_WEIGHT = "CASE " + " ".join(f"WHEN rule = '{r}' THEN {L.VIOLATION_COST[w]}" for r, w in L.RULE_WEIGHTS.items()) + " ELSE 1 END"


@query("agg1_document_statistics", f"{rules.violations_sql()}, pr AS (SELECT doc_id, rule, count(*) AS n, count(DISTINCT term) AS u FROM v GROUP BY doc_id, rule) SELECT doc_id, sum(n)::BIGINT AS total, sum(u)::BIGINT AS \"unique\", string_agg(rule || '=' || n, ',' ORDER BY rule) AS by_rule, sum(n * {_WEIGHT})::BIGINT AS weighted FROM pr GROUP BY doc_id")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = violations.statistics(table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform(F.map_entries("by_rule"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return s.select("doc_id", "total", "unique", said.alias("by_rule"), "weighted")


flagship = agg1


@query("agg14_forbidden_characters", f"WITH {annotate.TOKENS_SQL} SELECT term, count(*) AS n_docs FROM ({rules.FORBIDDEN_SQL}) GROUP BY term")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.forbidden_characters(corpus(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


@query("agg4_mean_sentence_length", f"WITH {rules.FEATURES_SQL} SELECT doc_id, sum(n_words)::BIGINT AS words, count(*) AS sents, floor(sum(n_words) / count(*) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS mean_words FROM sf GROUP BY doc_id HAVING sum(n_words) > 10 * count(*)")
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.sentence_features(corpus(spark, sf_dir)).groupBy("doc_id").agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("sents"))
    return s.where("words > 10 * sents").select("doc_id", "words", "sents", T.round2(F.col("words") / F.col("sents")).alias("mean_words"))


@query("agg5_sentence_counts", f"WITH {rules.FEATURES_SQL} SELECT doc_id, sent_no, n_long, n_counted, syll_counted, n_commas FROM sf WHERE n_long >= 3 OR n_commas > 2")
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sentence_features(corpus(spark, sf_dir)).where("n_long >= 3 OR n_commas > 2").select("doc_id", "sent_no", "n_long", "n_counted", "syll_counted", "n_commas")


@query("agg16_oov_ratio", f"""WITH {annotate.TOKENS_SQL}, vocab AS (SELECT lower FROM tok WHERE kind = 'w' GROUP BY lower HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, sent_no, count(*) AS n, count(*) FILTER (WHERE vocab.lower IS NULL) AS n_oov FROM tok LEFT JOIN vocab ON vocab.lower = tok.lower WHERE kind = 'w' GROUP BY doc_id, sent_no HAVING count(*) >= 3 AND 100 * count(*) FILTER (WHERE vocab.lower IS NULL) >= 15 * count(*)""")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.unshared_words(table(spark, sf_dir, "documents")).where("n >= 3 AND 100 * n_oov >= 15 * n")


@query("agg19_text_type", f"""WITH {rules.FEATURES_SQL}, x AS (SELECT doc_id, sum(n_words)::BIGINT AS w, count(*) AS n, sum(n_sub)::BIGINT AS sub, max(CASE WHEN contains(text, '·') OR contains(text, '∙') THEN 1 ELSE 0 END) AS dots, sum(length(text) - length(replace(text, ':', '')))::BIGINT AS colons, max(CASE WHEN regexp_matches(text, '[•○►▪-]') THEN 1 ELSE 0 END) AS bullets FROM sf GROUP BY doc_id)
SELECT doc_id, (CASE WHEN w < 10 * n THEN 2 ELSE 0 END) + 3 * dots + (CASE WHEN 10 * colons > n THEN 1 ELSE 0 END) + bullets + (CASE WHEN sub = 0 AND n > 5 THEN 1 ELSE 0 END) AS plain, (CASE WHEN w > 15 * n THEN 2 ELSE 0 END) + sub AS normal FROM x""")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.sentence_features(corpus(spark, sf_dir))
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    x = s.groupBy("doc_id").agg(
        F.sum("n_words").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("n_sub").alias("sub"), has(F.col("text").contains("·") | F.col("text").contains("∙")).alias("dots"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit(":"), F.lit("")))).alias("colons"), has(F.col("text").rlike("[•○►▪-]")).alias("bullets"),
    )
    one = lambda c, k=1: F.when(F.expr(c), k).otherwise(0)
    return x.select("doc_id", (one("w < 10 * n", 2) + 3 * F.col("dots") + one("10 * colons > n") + F.col("bullets") + one("sub = 0 AND n > 5")).alias("plain"), (one("w > 15 * n", 2) + F.col("sub")).alias("normal"))


@query("win2_first_occurrence", f"WITH {annotate.TOKENS_SQL} SELECT doc_id, lower, min(t_start) AS first_start, count(*) AS n FROM tok WHERE kind = 'w' GROUP BY doc_id, lower")
def win2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).tokens.where("kind = 'w'").groupBy("doc_id", "lower").agg(F.min("t_start").alias("first_start"), F.count(F.lit(1)).alias("n"))


@query("win3_long_word_runs", f"WITH {rules.FEATURES_SQL} SELECT doc_id, sent_no, length(run) AS run_length, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(long_flags, '1{{2,}}')) AS run FROM sf) GROUP BY ALL")
def win3(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rules.sentence_features(corpus(spark, sf_dir)).select("doc_id", "sent_no", F.explode(F.regexp_extract_all("long_flags", F.lit("1{2,}"), F.lit(0))).alias("run"))
    return runs.groupBy("doc_id", "sent_no", F.length("run").alias("run_length")).agg(F.count(F.lit(1)).alias("n"))


@query("win1_sentence_ordinal", f"WITH {annotate.SENTENCES_SQL} SELECT doc_id, max(sent_no) AS last_no, count(*) AS n FROM sent GROUP BY doc_id")
def win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).sentences.groupBy("doc_id").agg(F.max("sent_no").alias("last_no"), F.count(F.lit(1)).alias("n"))


@query("win10_sentence_end", f"WITH {annotate.SENTENCES_SQL} SELECT doc_id, sent_no, CAST(start_char + strpos(regexp_replace(text, '[!?]', '.', 'g'), '.') - 1 AS INTEGER) AS anchor FROM sent WHERE regexp_matches(text, '[.!?]')")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus(spark, sf_dir).sentences.where(F.col("text").rlike("[.!?]"))
    return s.select("doc_id", "sent_no", (F.col("start_char") + F.regexp_instr("text", F.lit("[.!?]")) - 1).cast("int").alias("anchor"))


@query("jn21_quoted_tokens", f"WITH {annotate.TOKENS_SQL} SELECT doc_id, sent_no, i, text FROM tok WHERE kind = 'w' AND prev1 IN ('\"', '„', '“', '»', '«') AND next1 IN ('\"', '“', '”', '«', '»')")
def jn21(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir).tokens
    return t.where((F.col("kind") == "w") & F.col("prev1").isin('"', "„", "“", "»", "«") & F.col("next1").isin('"', "“", "”", "«", "»")).select("doc_id", "sent_no", "i", "text")


@query("jn22_comma_before", f"WITH {annotate.TOKENS_SQL} SELECT doc_id, sent_no, i, lower, comma5 FROM (SELECT *, coalesce(max(CASE WHEN text = ',' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_no ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS comma5 FROM tok) WHERE lower IN ('der', 'die', 'das', 'dass', 'que', 'that')")
def jn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus(spark, sf_dir)
    ls = F.transform("ts", lambda t: t["lower"])
    rows = a.arrays.select("doc_id", "sent_no", ls.alias("ls")).select("doc_id", "sent_no", "ls", F.posexplode("ls").alias("i", "lower")).where(F.col("lower").isin("der", "die", "das", "dass", "que", "that"))
    five = F.slice("ls", F.greatest(F.col("i") - 4, F.lit(1)), F.least(F.col("i"), F.lit(5)))
    return rows.select("doc_id", "sent_no", "i", "lower", F.when(F.array_contains(five, ","), 1).otherwise(0).alias("comma5"))


@query("scalar_foreign_score", f"WITH {annotate.TOKENS_SQL} SELECT DISTINCT lower, {rules.duck_sql(rules.foreign_score(capital='false'))} AS score FROM tok WHERE kind = 'w' AND length(lower) >= 4")
def scalar_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus(spark, sf_dir).tokens.where("kind = 'w' AND length(lower) >= 4").select("lower", "n_syll").distinct()
    return words.select("lower", F.expr(rules.spark_sql(rules.foreign_score(capital="false"))).alias("score"))


@query("scalar_complexity_bonus", f"WITH {annotate.TOKENS_SQL} SELECT DISTINCT text, {rules.duck_sql(rules.complexity_bonus())} AS bonus FROM tok WHERE kind = 'w'")
def scalar_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).tokens.where("kind = 'w'").select("text", "lower").distinct().select("text", F.expr(rules.spark_sql(rules.complexity_bonus())).alias("bonus"))
