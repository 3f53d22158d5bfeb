"""Queries: companion analyses of the rules, prompt assembly, and smaller helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import annotate, compounds, rules
from ..operators.annotate import TOKENS_SQL, Annotated
from .registry import Inline, query, table


def _corpus(spark: SparkSession, sf_dir: str) -> Annotated:
    return Annotated(table(spark, sf_dir, "documents"))


@query("companion_sentence_profile", f"WITH {rules.FEATURES_SQL} SELECT doc_id, count(*) AS sents, max(n_words) AS longest, CAST(sum(n_words) AS BIGINT) AS words, CASE WHEN sum(n_words) > 15 * count(*) THEN 'schwer' WHEN sum(n_words) > 10 * count(*) THEN 'mittel' ELSE 'leicht' END AS level FROM sf GROUP BY doc_id")
def sentence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.sentence_features(_corpus(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sents"), F.max("n_words").alias("longest"), F.sum("n_words").alias("words"))
    return s.withColumn("level", F.expr("CASE WHEN words > 15 * sents THEN 'schwer' WHEN words > 10 * sents THEN 'mittel' ELSE 'leicht' END"))


@query("companion_structure_profile", f"WITH {rules.FEATURES_SQL} SELECT doc_id, CAST(sum(n_sub) AS BIGINT) AS clauses, CAST(sum(n_passive) AS BIGINT) AS passives, CAST(sum(n_commas) AS BIGINT) AS commas, CAST(sum(n_nominal) AS BIGINT) AS nominals FROM sf GROUP BY doc_id")
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.sentence_features(_corpus(spark, sf_dir)).groupBy("doc_id")
    return s.agg(F.sum("n_sub").alias("clauses"), F.sum("n_passive").alias("passives"), F.sum("n_commas").alias("commas"), F.sum("n_nominal").alias("nominals"))


@query("companion_foreign_density", f"WITH {TOKENS_SQL}, w AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(lower) >= 4 AND {rules.duck_sql(rules.foreign_score())} >= 8) AS n_foreign FROM tok WHERE kind = 'w' GROUP BY doc_id) SELECT doc_id, n, n_foreign, 100.0::DOUBLE * n_foreign / n AS density FROM w")
def foreign_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _corpus(spark, sf_dir).tokens.where("kind = 'w'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.length("lower") >= 4) & (F.expr(rules.spark_sql(rules.foreign_score())) >= 8)).alias("n_foreign"))
    return w.select("doc_id", "n", "n_foreign", (F.lit(100.0) * F.col("n_foreign") / F.col("n")).alias("density"))


@query("companion_capital_consistency", f"WITH {TOKENS_SQL}, w AS (SELECT doc_id, lower, count(DISTINCT text) AS forms FROM tok WHERE kind = 'w' GROUP BY doc_id, lower) SELECT doc_id, count(*) AS words, 1.0::DOUBLE - count(*) FILTER (WHERE forms > 1) / count(*)::DOUBLE AS consistency FROM w GROUP BY doc_id")
def capital_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _corpus(spark, sf_dir).tokens.where("kind = 'w'").select("doc_id", "lower", "text").distinct().groupBy("doc_id", "lower").agg(F.count(F.lit(1)).alias("forms"))
    return forms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), (F.lit(1.0) - F.count_if(F.col("forms") > 1) / F.count(F.lit(1)).cast("double")).alias("consistency"))


@query("aux3_likely_foreign", f"WITH {TOKENS_SQL} SELECT DISTINCT lower FROM tok WHERE kind = 'w' AND length(lower) >= 5 AND regexp_matches(lower, '(tion|sion|ität|ismus|ment|ant|ent|anz|enz|al|ell|iv|ar|är|ik|ur|ös|os|isch)$')")
def aux3(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = "(tion|sion|ität|ismus|ment|ant|ent|anz|enz|al|ell|iv|ar|är|ik|ur|ös|os|isch)$"
    return _corpus(spark, sf_dir).tokens.where("kind = 'w' AND length(lower) >= 5").where(F.col("lower").rlike(endings)).select("lower").distinct()


@query("aux10_score_categories", f"WITH {TOKENS_SQL} SELECT c AS category, count(*) AS n FROM (SELECT CASE WHEN b < 25 THEN 'einfach' WHEN b < 40 THEN 'mittel' ELSE 'schwer' END AS c FROM (SELECT 2 * {rules.duck_sql(rules.complexity_bonus())} AS b FROM tok WHERE kind = 'w')) GROUP BY c")
def aux10(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _corpus(spark, sf_dir).tokens.where("kind = 'w'").select((2 * F.expr(rules.spark_sql(rules.complexity_bonus()))).alias("b"))
    return b.groupBy(F.expr("CASE WHEN b < 25 THEN 'einfach' WHEN b < 40 THEN 'mittel' ELSE 'schwer' END").alias("category")).agg(F.count(F.lit(1)).alias("n"))


_POLITE = ("Sie", "Ihnen", "Ihr", "Ihre", "Ihren", "Ihrem", "Ihrer", "Ihres")
_REFLEXIVE = ("sich", "mich", "dich", "uns", "euch")


@query("aux13_polite_forms", f"WITH {TOKENS_SQL} SELECT doc_id, t_start, text, CASE WHEN text IN ({', '.join(map(repr, _POLITE))}) THEN 'polite' ELSE 'reflexive' END AS kind FROM tok WHERE text IN ({', '.join(map(repr, _POLITE))}) AND i > 0 OR lower IN ({', '.join(map(repr, _REFLEXIVE))})")
def aux13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised forms of address inside a sentence, and reflexive pronouns."""
    polite = F.col("text").isin(*_POLITE)
    found = _corpus(spark, sf_dir).tokens.where((F.col("i") > 0) & polite | F.col("lower").isin(*_REFLEXIVE))
    return found.select("doc_id", "t_start", "text", F.when(polite, "polite").otherwise("reflexive").alias("kind"))


_ALTERNATIVES = Inline("word string, alternative string", [(w, a) for w, plain, others in L.SYNONYMS for a in dict.fromkeys((plain.lower(), *others))])


@query("srt5_best_alternative", f"WITH {TOKENS_SQL}, f AS (SELECT lower, count(*) AS n FROM tok WHERE kind = 'w' GROUP BY lower) SELECT word, alternative AS best, n FROM (SELECT word, alternative, coalesce(f.n, 0) AS n, row_number() OVER (PARTITION BY word ORDER BY coalesce(f.n, 0) DESC, length(alternative), alternative) AS r FROM {_ALTERNATIVES.sql()} x LEFT JOIN f ON f.lower = x.alternative) WHERE r = 1")
def srt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best alternative of each listed word: most frequent in the corpus, then shortest."""
    given = _ALTERNATIVES.df(spark)
    asked = _corpus(spark, sf_dir).tokens.where("kind = 'w'").select(F.col("lower").alias("alternative")).join(F.broadcast(given.select("alternative").distinct()), "alternative", "left_semi")
    n = asked.groupBy("alternative").agg(F.count(F.lit(1)).alias("n"))
    x = given.join(n, "alternative", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    best = x.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("back"), F.length("alternative").alias("l"), "alternative")).alias("b"))
    return best.select("word", F.col("b.alternative").alias("best"), (-F.col("b.back")).alias("n"))


@query("prj19_embedded_shapes", f"WITH {TOKENS_SQL} SELECT doc_id, t_start, text FROM tok WHERE regexp_matches(text, '^[A-ZÄÖÜ]{{2,}}$') AND coalesce(prev1, '') <> '-' AND coalesce(next1, '') <> '-'")
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    lone = (F.coalesce("prev1", F.lit("")) != "-") & (F.coalesce("next1", F.lit("")) != "-")
    return _corpus(spark, sf_dir).tokens.where(F.col("text").rlike("^[A-ZÄÖÜ]{2,}$") & lone).select("doc_id", "t_start", "text")


PROMPTS = Inline("rule string, title string, priority string", [("genitiv", "Kein Genitiv", "low"), ("satzlaenge", "Kurze Sätze", "high"), ("negationen", "Positiv", "medium"), ("passiv_erkennung", "Aktiv", "high"), ("zahlwoerter", "Ziffern", "?")])
_ORDER = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"


@query("srt7_system_prompt", f"SELECT string_agg('- ' || title, chr(10) ORDER BY {_ORDER}, rule) AS prompt FROM {PROMPTS.sql()}")
def srt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = PROMPTS.df(spark).agg(F.sort_array(F.collect_list(F.struct(F.expr(_ORDER).alias("o"), "rule", "title"))).alias("p"))
    return ordered.select(F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("prompt"))


JUDGED = Inline("id int, score int, missing array<string>, added array<string>", [(1, 5, [], []), (2, 3, ["Frist"], ["Ort", "Zeit"]), (3, 2, ["Name", "Amt"], [])])


@query("gen5_feedback", f"SELECT id, score >= 4 AS faithful, concat_ws('. ', CASE WHEN len(missing) > 0 THEN 'Es fehlt: ' || array_to_string(missing, ', ') END, CASE WHEN len(added) > 0 THEN 'Hinzugefügt: ' || array_to_string(added, ', ') END) AS feedback FROM {JUDGED.sql()}")
def gen5(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, lead: F.when(F.size(c) > 0, F.concat(F.lit(lead), F.array_join(c, ", ")))
    return JUDGED.df(spark).select("id", (F.col("score") >= 4).alias("faithful"), F.concat_ws(". ", part("missing", "Es fehlt: "), part("added", "Hinzugefügt: ")).alias("feedback"))


FEATURES = Inline("id int, subjects int, contrast boolean, coherent boolean, close boolean, far boolean, copula boolean, modal boolean, coord boolean, commas int, plain boolean", [(1, 2, False, False, False, False, False, False, False, 0, True), (2, 1, False, True, True, False, False, False, False, 0, False), (3, 1, False, True, False, True, False, False, False, 0, True), (4, 1, False, False, False, False, True, False, False, 0, True), (5, 1, False, False, False, False, False, True, False, 0, False), (6, 1, False, False, False, False, False, False, True, 2, True), (7, 1, False, False, False, False, False, False, False, 0, False)])
_ADJUST = "(CASE WHEN plain THEN -0.03{d} ELSE 0.0{d} END)"
_LADDER = "CASE WHEN subjects > 1 OR contrast THEN 0.5{d} + {a} * 0.5{d} WHEN coherent THEN 0.8{d} + {a} + (CASE WHEN close THEN 0.05{d} WHEN far THEN -0.05{d} ELSE 0.0{d} END) WHEN copula THEN 0.95{d} + {a} * 0.5{d} WHEN modal AND NOT coord THEN 0.85{d} + {a} WHEN coord AND commas >= 2 THEN 0.7{d} + {a} ELSE 0.75{d} + {a} END"


def _ladder(d: str) -> str:
    return _LADDER.format(d=d, a=_ADJUST.format(d=d))


@query("scalar_adaptive_threshold", f"SELECT id, {_ladder('::DOUBLE')} AS threshold FROM {FEATURES.sql()}")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FEATURES.df(spark).select("id", F.expr(_ladder("D")).alias("threshold"))


COMPOUNDS = Inline("word string, parts array<string>", [("Arbeitsamt", ["arbeit", "amt"]), ("Krankenkasse", ["kranken", "kasse"]), ("Liebesbrief", ["liebe", "brief"]), ("Haustür", ["haus", "tür"])])


@query("scalar_hyphen_join", f"SELECT word, substring(lower(word), 1, strpos(lower(word), parts[2]) - 1) || '-' || parts[2] AS hyphenated, length(word) - length(parts[1]) - length(parts[2]) AS link FROM {COMPOUNDS.sql()}")
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linking sound stays with the first part."""
    second = F.element_at("parts", 2)
    head = F.expr("substring(lower(word), 1, instr(lower(word), parts[1]) - 1)")
    return COMPOUNDS.df(spark).select("word", F.concat(head, F.lit("-"), second).alias("hyphenated"), (F.length("word") - F.length(F.element_at("parts", 1)) - F.length(second)).cast("long").alias("link"))


@query("aux11_longest_match_split", f"WITH {TOKENS_SQL} SELECT lower, regexp_extract(lower, '^(.{{3,}})(ung|heit|keit|schaft|tion|ment|able|tion|mente|ción)$', 1) AS head, regexp_extract(lower, '^(.{{3,}})(ung|heit|keit|schaft|tion|ment|able|tion|mente|ción)$', 2) AS tail FROM (SELECT DISTINCT lower FROM tok WHERE kind = 'w' AND length(lower) >= 8) WHERE regexp_matches(lower, '^.{{3,}}(ung|heit|keit|schaft|tion|ment|able|tion|mente|ción)$')")
def aux11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "^(.{3,})(ung|heit|keit|schaft|tion|ment|able|tion|mente|ción)$"
    w = annotate.distinct_words(table(spark, sf_dir, "documents")).where("length(lower) >= 8").where(F.col("lower").rlike(p)).select("lower").distinct()
    return w.select("lower", F.regexp_extract("lower", p, 1).alias("head"), F.regexp_extract("lower", p, 2).alias("tail"))


@query("aux11_compound_splits")
def aux11_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents cut into other words of them, by each variant. (Tests hold the cuts against all cuts.)"""
    words = annotate.word_counts(table(spark, sf_dir, "documents")).where("NOT contains(lower, '-')").withColumnRenamed("lower", "word")
    found = compounds.split(words)
    return found.select("word", "n", *(F.array_join(v, "-").alias(v) for v in compounds.COSTS))


@query("win12_plateaus", "SELECT user_id, count(*) AS n, max(run) AS longest FROM (SELECT user_id, g, count(*) AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, event_type, g) GROUP BY user_id")
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same outcome: how many, and the longest."""
    all_of = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    same = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    runs = table(spark, sf_dir, "events").withColumn("g", all_of - same).groupBy("user_id", "event_type", "g").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("longest"))


@query("scalar_sentence_previews", f"WITH {TOKENS_SQL} SELECT doc_id, sent_no, CASE WHEN length(t) > 80 THEN substring(t, 1, 80) || '...' ELSE t END AS preview FROM (SELECT doc_id, sent_no, regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS t FROM sent)")
def sentence_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).sentences.select("doc_id", "sent_no", T.truncated(T.strip(F.col("text")), 80).alias("preview"))
