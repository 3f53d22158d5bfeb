"""Queries on small fixed tables: the operators whose inputs the driver's tables don't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import evaluation, planner, training, violations
from .registry import Inline, query

FIXTURES = Inline(
    "name string, value string",
    [
        ("a", "# expected: flag\n# description: Langer Satz\n\nDieser Satz ist lang."),
        ("b", "# expected: pass\n\nKurz.\nZwei Zeilen."),
        ("c", "Kein Kopf."),
        ("d", "#expected:  FLAG  \n# length: short\n# category: recht\nText mit # Zeichen."),
    ],
)


@query(
    "src2_fixture_parse",
    f"""SELECT name, nullif(regexp_extract(value, '(?im)^#\\s*expected:[ \\t]*([a-z]+)', 1), '') AS expected, nullif(regexp_extract(value, '(?im)^#\\s*description:[ \\t]*([^\\n]+)', 1), '') AS description,
    regexp_replace(regexp_replace(value, '(?m)^#[^\\n]*$', '', 'g'), '^\\n+', '') AS body FROM {FIXTURES.sql()}""",
)
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    head = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    return FIXTURES.df(spark).select("name", head(r"(?im)^#\s*expected:[ \t]*([a-z]+)").alias("expected"), head(r"(?im)^#\s*description:[ \t]*([^\n]+)").alias("description"), F.regexp_replace(F.regexp_replace(v, r"(?m)^#[^\n]*$", ""), r"^\n+", "").alias("body"))


@query(
    "src4_corpus_headers",
    f"""SELECT name, k AS key, v AS val, n_words FROM (SELECT name, unnest(regexp_extract_all(value, '(?m)^#[ ]*([a-z]+):[ ]*[^\\n]*', 1)) AS k, unnest(regexp_extract_all(value, '(?m)^#[ ]*[a-z]+:[ ]*([^\\n]*)', 1)) AS v,
    CAST(len(list_filter(regexp_split_to_array(regexp_replace(value, '(?m)^#[^\\n]*$', '', 'g'), '[ \\n]+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM {FIXTURES.sql()})""",
)
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"(?m)^#[ ]*([a-z]+):[ ]*[^\n]*"), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(r"(?m)^#[ ]*[a-z]+:[ ]*([^\n]*)"), F.lit(1)).alias("v"))
    words = F.size(F.filter(F.split(F.regexp_replace("value", r"(?m)^#[^\n]*$", ""), r"[ \n]+"), lambda x: x != ""))
    return FIXTURES.df(spark).select("name", F.explode(pairs).alias("p"), words.alias("n_words")).select("name", F.col("p.k").alias("key"), F.col("p.v").alias("val"), "n_words")


RECORDS = Inline("line string", [('{"provider": "a", "model": "m", "text_id": "t1", "n": 3}',), ("{broken",), ("",), ('{"provider": "b", "model": "m", "text_id": "t2"}',), ('["no object"]',)])


@query("src6_tolerant_jsonl", f"SELECT j->>'provider' AS provider, j->>'model' AS model, j->>'text_id' AS text_id, CAST(j->>'n' AS BIGINT) AS n FROM (SELECT CAST(line AS JSON) AS j FROM {RECORDS.sql()} WHERE json_valid(line)) WHERE j->>'provider' IS NOT NULL")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = RECORDS.df(spark).select(F.from_json("line", "provider string, model string, text_id string, n long").alias("r"))
    return parsed.where("r.provider IS NOT NULL").select("r.*")


SYNSETS = Inline("sid int, words array<string>", [(1, ["Auto", "Wagen", "PKW"]), (2, ["wagen", "Karren"]), (3, ["Haus"])])


@query("src10_thesaurus_index", f"SELECT lemma, string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid) AS sids FROM (SELECT DISTINCT lower(w) AS lemma, sid FROM (SELECT sid, unnest(words) AS w FROM {SYNSETS.sql()})) GROUP BY lemma")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SYNSETS.df(spark).select("sid", F.explode("words").alias("w")).groupBy(F.lower("w").alias("lemma")).agg(F.array_sort(F.collect_set("sid")).alias("s"))
    return rows.select("lemma", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sids"))


PROBS = Inline("json string", [('{"haus": 0.5, "information": 0.001, "x": 0.0}',)])


@query("src11_probability_map", f"SELECT word, CAST(json_extract(json, '$.' || word) AS DOUBLE) AS p FROM (SELECT json, unnest(json_keys(json)) AS word FROM {PROBS.sql()})")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PROBS.df(spark).select(F.explode(F.from_json("json", "map<string,double>")).alias("word", "p"))


PROMPTS = Inline("rule string, content string", [("negationen", "# Negationen\n\n## Regel\nSag, was ist.\n\n## Muster\n- \"nicht\"\n- 'kein'\n\n## Prioritaet\nhigh\n"), ("genitiv", "# Genitiv\n\n## Regel\nNutze von.\n## Prioritaet\nlow\n")])


@query(
    "src12_prompt_sections",
    f"""SELECT rule, lower(trim(split_part(s, chr(10), 1))) AS section, CAST(len(list_filter(string_split(s, chr(10)), lambda x: starts_with(x, '- '))) AS INTEGER) AS n_items,
    array_to_string(list_transform(list_filter(string_split(s, chr(10)), lambda x: starts_with(x, '- ')), lambda x: regexp_replace(x[3:], '^["'']|["'']$', '', 'g')), '|') AS items
    FROM (SELECT rule, unnest(regexp_split_to_array(content, '(?m)^##[ ]+')[2:]) AS s FROM {PROMPTS.sql()})""",
)
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("content", r"(?m)^##[ ]+")
    s = PROMPTS.df(spark).select("rule", F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("s"))
    items = F.filter(F.split("s", "\n"), lambda x: x.startswith("- "))
    return s.select("rule", F.lower(F.trim(F.substring_index("s", "\n", 1))).alias("section"), F.size(items).alias("n_items"), F.array_join(F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(3), F.length(x)), "^[\"']|[\"']$", "")), "|").alias("items"))


MESSAGES = Inline(
    "ord int, rule string, message string, text string",
    [
        (1, "fremdwoerter", 'Fremdwort "Service" (mittel). Einfacher: "Dienst".', "Der Service ist gut. service!"),
        (2, "zahlwoerter", "Zahlwort. Text-Position: 4-8", "Die zwei Kinder"),
        (3, "satzlaenge", "Satz 1 ist zu komplex (14 Wörter). Teilen.", "Ein Satz."),
        (4, "negationen", 'Negation "kein" hier. Besser: "ohne".', "keine und kein, KEIN"),
        (5, "komposita", 'Kompositum "Rathaus-Amt".', "Das Rathaus-Amt"),
        (6, "komposita", 'Kompositum "Heidelberg" ohne Vorschlag', "In Heidelberg"),
        (7, "zahlwoerter", "Text-Position: 90-95", "kurz"),
        (8, "mehrere_aussagen", "", "x"),
        (9, "genitiv", 'Leer "" und "des Hauses".', "Das Dach des Hauses."),
        (10, "redewendungen", 'Richtig: "so". Ersetzen durch: "anders"', "so"),
    ],
)
_SUGGESTION_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(message, '{p}', 1), '')" for p in L.SUGGESTION_PATTERNS) + ")"
_QUOTED_SQL = "nullif(regexp_extract(message, '\"([^\"]+)\"', 1), '')"
_PROBLEM_SQL = f"coalesce({_QUOTED_SQL}, substring(trim(string_split_regex(message, '[.,]')[1]), 1, 50))"


@query("prj2_problematic_text", f"SELECT ord, {_PROBLEM_SQL} AS term FROM {MESSAGES.sql()}")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESSAGES.df(spark).select("ord", T.problematic_text(F.col("message")).alias("term"))


@query(
    "prj3_positions",
    f"""WITH m AS (SELECT *, TRY_CAST(nullif(regexp_extract(message, 'Text-Position:\\s*([0-9]+)-([0-9]+)', 1), '') AS INTEGER) AS a, TRY_CAST(nullif(regexp_extract(message, 'Text-Position:\\s*([0-9]+)-([0-9]+)', 2), '') AS INTEGER) AS b FROM {MESSAGES.sql()}),
    q AS (SELECT ord, text, unnest(regexp_extract_all(message, '"([^"]+)"', 1)) AS q, generate_subscripts(regexp_extract_all(message, '"([^"]+)"', 1), 1) AS k FROM m),
    c AS (SELECT ord, k, i - 1 AS s, CAST(i - 1 + length(q) AS BIGINT) AS e FROM (SELECT *, unnest(generate_series(1, length(text))) AS i FROM q)
      WHERE lower(substring(text, i, length(q))) = lower(q) AND regexp_matches(substring(' ' || text || ' ', i, 1), '^[^\\p{{L}}0-9_]') AND regexp_matches(substring(' ' || text || ' ', i + length(q) + 1, 1), '^[^\\p{{L}}0-9_]')),
    f AS (SELECT ord, arg_min(s, (k, s)) AS s, arg_min(e, (k, s)) AS e FROM c GROUP BY ord)
    SELECT m.ord, CAST(CASE WHEN a < length(text) AND a < b AND b <= length(text) THEN a ELSE f.s END AS INTEGER) AS p_start, CAST(CASE WHEN a < length(text) AND a < b AND b <= length(text) THEN b ELSE f.e END AS INTEGER) AS p_end FROM m LEFT JOIN f ON f.ord = m.ord""",
)
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations.resolved(MESSAGES.df(spark)).select("ord", F.col("p_start").cast("int").alias("p_start"), F.col("p_end").cast("int").alias("p_end"))


@query("prj4_rule_suffix", f"SELECT ord, replace(rule || '_issue', '_issue', '') AS rule FROM {MESSAGES.sql()}")
def prj4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESSAGES.df(spark).select("ord", violations.rule_name(F.concat("rule", F.lit("_issue"))).alias("rule"))


_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(
    "prj5_difficulty",
    f"""SELECT ord, CASE WHEN {_SUGGESTION_SQL} IS NOT NULL THEN 'fixable' WHEN rule IN ('komposita', 'kurze_woerter', 'fremdwoerter') AND regexp_matches(term, '^\\p{{Lu}}') AND (regexp_matches(term, '^.[^\\n]*[\\p{{Lu}}-]') OR (length(term) > 5 AND regexp_matches(term, '(berg|burg|dorf|heim|tal)$'))) THEN 'difficult'
    WHEN rule IN ({_LIST(L.EASY_RULES)}) THEN 'fixable' WHEN rule IN ({_LIST(L.HARD_RULES)}) THEN 'difficult' ELSE 'fixable' END AS difficulty FROM (SELECT *, {_PROBLEM_SQL} AS term FROM {MESSAGES.sql()})""",
)
def prj5(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MESSAGES.df(spark).withColumn("term", T.problematic_text(F.col("message")))
    return m.select("ord", violations.difficulty(F.col("term"), F.col("rule"), F.col("message")).alias("difficulty"))


@query("prj6_suggestion", f"SELECT ord, {_SUGGESTION_SQL} AS suggestion FROM {MESSAGES.sql()}")
def prj6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESSAGES.df(spark).select("ord", T.suggestion(F.col("message")).alias("suggestion"))


_TEMPLATE_SQL = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{t}'" for r, t in L.FALLBACK_INSTRUCTIONS.items()) + " END"


@query("prj7_instruction", f"SELECT ord, coalesce('Ersetze \"' || coalesce({_QUOTED_SQL}, text) || '\" durch \"' || {_SUGGESTION_SQL} || '\"', replace({_TEMPLATE_SQL}, '{{word}}', substring(coalesce({_QUOTED_SQL}, text, ''), 1, 30))) AS instruction FROM {MESSAGES.sql()}")
def prj7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESSAGES.df(spark).select("ord", violations.instruction(F.col("rule"), F.col("message"), F.col("text")).alias("instruction"))


PHRASES = Inline("id int, text string", [(1, "Das muss gemacht werden"), (2, "Das ist zu tun"), (3, "Es wird gebaut"), (4, "Es wurde gebaut"), (5, "Er kommt, weil er will"), (6, "Der Mann, der geht"), (7, "Donaudampfschifffahrtsgesellschaft"), (8, "Versicherungskarte"), (9, "Zeitung"), (10, "Freiheit"), (11, "Nation"), (12, "Realismus"), (13, "studieren"), (14, "aktiv"), (15, "Haus"), (16, "obwohl damit bevor")])
_CONJ = (("weil", "weil-Sätze"), ("dass", "dass-Sätze"), ("wenn", "wenn-Sätze"), ("obwohl", "obwohl-Sätze"), ("damit", "damit-Sätze"), ("nachdem", "nachdem-Sätze"), ("bevor", "bevor-Sätze"), ("als", "als-Sätze (temporal)"))


@query(
    "prj8_pattern_labels",
    f"""SELECT id, CASE WHEN contains(t, 'muss') OR contains(t, 'kann') OR contains(t, 'soll') THEN 'Modalverb + Partizip + werden' WHEN contains(t, 'ist zu') OR contains(t, 'sind zu') THEN 'ist/sind zu + Infinitiv' WHEN contains(t, 'werden') OR contains(t, 'wird') THEN 'werden + Partizip II' WHEN contains(t, 'wurde') THEN 'wurde/wurden + Partizip II' END AS passive,
    CASE {' '.join(f"WHEN contains(t, '{c}') THEN '{p}'" for c, p in _CONJ)} WHEN contains(t, ', der ') OR contains(t, ', die ') OR contains(t, ', das ') THEN 'Relativsätze' END AS clause,
    CASE WHEN length(text) > 20 THEN 'Sehr lange Komposita (20+ Zeichen)' WHEN length(text) > 15 THEN 'Lange Komposita (15-20 Zeichen)' WHEN ends_with(t, 'ung') THEN 'Komposita auf -ung' WHEN ends_with(t, 'heit') OR ends_with(t, 'keit') THEN 'Komposita auf -heit/-keit' END AS compound,
    CASE WHEN ends_with(t, 'tion') THEN 'Wörter auf -tion' WHEN ends_with(t, 'ismus') THEN 'Wörter auf -ismus' WHEN ends_with(t, 'ieren') THEN 'Verben auf -ieren' WHEN ends_with(t, 'iv') THEN 'Adjektive auf -iv' END AS foreign_word
    FROM (SELECT *, lower(text) AS t FROM {PHRASES.sql()})""",
)
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    has = lambda *xs: t.rlike("|".join(xs))
    clause = F.when(F.lit(False), "")
    for c, p in _CONJ:
        clause = clause.when(t.contains(c), p)
    return PHRASES.df(spark).select(
        "id",
        F.when(has("muss", "kann", "soll"), "Modalverb + Partizip + werden").when(has("ist zu", "sind zu"), "ist/sind zu + Infinitiv").when(has("werden", "wird"), "werden + Partizip II").when(has("wurde"), "wurde/wurden + Partizip II").alias("passive"),
        clause.when(has(", (der|die|das) "), "Relativsätze").alias("clause"),
        F.when(F.length("text") > 20, "Sehr lange Komposita (20+ Zeichen)").when(F.length("text") > 15, "Lange Komposita (15-20 Zeichen)").when(has("ung$"), "Komposita auf -ung").when(has("(heit|keit)$"), "Komposita auf -heit/-keit").alias("compound"),
        F.when(has("tion$"), "Wörter auf -tion").when(has("ismus$"), "Wörter auf -ismus").when(has("ieren$"), "Verben auf -ieren").when(has("iv$"), "Adjektive auf -iv").alias("foreign_word"),
    )


@query("prj9_generic_example", f"SELECT ord, CASE WHEN rule NOT IN ({_LIST(L.CONTENT_RULES)}) THEN list_filter(regexp_extract_all(message, '\"([^\"]+)\"', 1), lambda q: length(q) <= 30 AND length(q) - length(replace(q, ' ', '')) <= 3)[1] END AS example FROM {MESSAGES.sql()}")
def prj9(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.filter(T.quoted(F.col("message")), lambda q: (F.length(q) <= 30) & (F.length(q) - F.length(F.replace(q, F.lit(" "), F.lit(""))) <= 3))
    return MESSAGES.df(spark).select("ord", F.when(~F.col("rule").isin(*L.CONTENT_RULES), F.get(short, F.lit(0))).alias("example"))


LABELS = Inline("id int, labels array<string>, n_statements int", [(1, ["O", "B-ABK", "B-ABK", ".", "I-ABK"], 0), (2, ["B-ABK", "O", "B-ABK"], 1), (3, ["I-ABK", "B-ABK", "X"], 5), (4, [], 2)])
_BIO = ["O", "B-ABK", "I-ABK"]


@query("prj12_label_cleaning", f"SELECT id, array_to_string(list_transform(labels, lambda x: CASE WHEN x IN ('O', 'B-ABK', 'I-ABK') THEN x ELSE 'O' END), ' ') AS labels, CAST(n_statements > 1 AS INTEGER) AS several, CAST(greatest(least(n_statements, 4) - 1, 0) AS INTEGER) AS bucket FROM {LABELS.sql()}")
def prj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LABELS.df(spark).select("id", F.array_join(training.known_labels(F.col("labels"), _BIO), " ").alias("labels"), (F.col("n_statements") > 1).cast("int").alias("several"), F.greatest(F.least("n_statements", F.lit(4)) - 1, F.lit(0)).alias("bucket"))


@query("win6_bio_repair", f"SELECT id, array_to_string(list_transform(labels, lambda x, i: CASE WHEN starts_with(x, 'B-') AND i > 1 AND regexp_matches(labels[i - 1], '^[BI]-') THEN 'I-' || x[3:] ELSE x END), ' ') AS labels FROM {LABELS.sql()}")
def win6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LABELS.df(spark).select("id", F.array_join(training.repaired_bio(F.col("labels")), " ").alias("labels"))


STATEMENTS = Inline("id int, phrase string, n string", [(1, "Ein \\emph Satz  hier", "1"), (2, None, "2"), (3, "Zwei\tSätze \\textbf", "x"), (4, "Viele", "11"), (5, "  Rand ", "3")])


@query("prj13_row_cleaning", f"SELECT id, trim(regexp_replace(regexp_replace(phrase, '\\\\[a-zA-Z]+', '', 'g'), '[ \\t\\n]+', ' ', 'g')) AS phrase, TRY_CAST(n AS INTEGER) AS n FROM {STATEMENTS.sql()} WHERE phrase IS NOT NULL AND TRY_CAST(n AS INTEGER) BETWEEN 1 AND 10")
def prj13(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("try_cast(n AS INT)")
    text = F.trim(F.regexp_replace(F.regexp_replace("phrase", r"\\[a-zA-Z]+", ""), r"[ \t\n]+", " "))
    return STATEMENTS.df(spark).na.drop(subset=["phrase"]).where(n.between(1, 10)).select("id", text.alias("phrase"), n.alias("n"))


ENCODERS = Inline("side string, head string, label string", [("a", "case", "nom"), ("a", "case", "acc"), ("b", "case", "nom"), ("b", "number", "sg"), ("a", "number", "sg")])


@query("prj14_schema_mismatch", f"WITH e AS {ENCODERS.sql()} SELECT coalesce(x.head, y.head) AS head, coalesce(x.label, y.label) AS label, CASE WHEN x.head IS NULL THEN 'a' ELSE 'b' END AS missing_in FROM (SELECT * FROM e WHERE side = 'a') x FULL JOIN (SELECT * FROM e WHERE side = 'b') y ON x.head = y.head AND x.label = y.label WHERE x.head IS NULL OR y.head IS NULL")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ENCODERS.df(spark)
    x, y = e.where("side = 'a'").select("head", "label", F.lit(True).alias("in_a")), e.where("side = 'b'").select("head", "label", F.lit(True).alias("in_b"))
    return x.join(y, ["head", "label"], "full_outer").where("in_a IS NULL OR in_b IS NULL").select("head", "label", F.when(F.col("in_a").isNull(), "a").otherwise("b").alias("missing_in"))


PAIRS = Inline("id int, source string, candidate string", [(1, "Dies ist ein langer Satz über Dinge.", "Dies ist [...]"), (2, "Dies ist ein langer Satz.", "Kurz."), (3, "Ein Satz hier.", "Ein Satz da."), (4, "Ein Satz.", ""), (5, "Ein Satz.", "Rest bleibt gleich"), (6, "Ein guter alter Satz.", "siehe  oben und mehr"), (7, "abc", None), (8, "Ein Satz.", "Wie oben beschrieben")])
_LAZY_SQL = "coalesce(trim(candidate), '') = '' OR " + " OR ".join(f"regexp_matches(candidate, '{p}')" for p in L.LAZY_PATTERNS) + " OR length(trim(candidate)) < 0.4 * length(trim(source))"


@query("prj16_lazy_rewrites", f"SELECT id, {_LAZY_SQL} AS lazy FROM {PAIRS.sql()}")
def prj16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PAIRS.df(spark).select("id", planner.looks_lazy(F.col("candidate"), F.col("source")).alias("lazy"))


@query("prj17_acceptable")
def prj17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PAIRS.df(spark).select("id", planner.similarity("candidate", "source").alias("similarity"), planner.acceptable(F.col("candidate"), F.col("source")).alias("acceptable"))


SPANS = Inline("doc_id int, word string, s int, e int, score double, label string, source string", [(1, "##zwei", 0, 4, 0.9, "BAD", "bert"), (1, "x", 5, 6, 0.9, "BAD", "bert"), (1, "7", 7, 8, 0.7, "BAD", "bert"), (1, "drei", 9, 13, 0.5, "BAD", "bert"), (1, "zwei", 0, 4, 1.0, "RULE", "rule"), (2, "ten", 0, 3, 0.95, "O", "bert"), (2, "hundert", 3, 10, 0.8, "BAD", "bert"), (2, "IV", 8, 10, 1.0, "ROMAN", "regex"), (2, "vier", 20, 24, 1.0, "RULE", "rule"), (2, "vierzig", 20, 27, 1.0, "REGEX", "regex")])


@query("prj18_span_filter", f"SELECT doc_id, regexp_replace(word, '^##', '') AS word, s, e, score FROM {SPANS.sql()} WHERE source = 'bert' AND score >= 0.6 AND label <> 'O' AND (length(regexp_replace(word, '^##', '')) >= 2 OR regexp_matches(word, '^[0-9]+$')) AND regexp_replace(word, '^##', '') NOT IN ('te', 'ten', 'ter')")
def prj18(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = SPANS.df(spark).where("source = 'bert' AND score >= 0.6 AND label <> 'O'").withColumn("word", F.regexp_replace("word", "^##", ""))
    return x.where(((F.length("word") >= 2) | F.col("word").rlike("^[0-9]+$")) & ~F.col("word").isin("te", "ten", "ter")).select("doc_id", "word", "s", "e", "score")


@query(
    "win5_greedy_merge",
    f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, CASE source WHEN 'rule' THEN 1 WHEN 'bert' THEN 2 ELSE 3 END, e) AS k FROM {SPANS.sql()}),
    step AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT doc_id FROM x)
      UNION ALL SELECT st.doc_id, st.k + 1, CASE WHEN list_contains(st.used, st.k + 1) THEN st.used ELSE list_concat(st.used, (SELECT list(o.k) FROM x o WHERE o.doc_id = st.doc_id AND o.k >= st.k + 1 AND NOT list_contains(st.used, o.k) AND (o.k = me.k OR 2 * (least(o.e, me.e) - greatest(o.s, me.s)) >= least(o.e - o.s, me.e - me.s)))) END,
        CASE WHEN list_contains(st.used, st.k + 1) THEN st.kept ELSE list_append(st.kept, (SELECT arg_max(o.k, (CASE o.source WHEN 'bert' THEN 3 WHEN 'regex' THEN 2 ELSE 1 END, -o.k)) FROM x o WHERE o.doc_id = st.doc_id AND o.k >= st.k + 1 AND NOT list_contains(st.used, o.k) AND (o.k = me.k OR 2 * (least(o.e, me.e) - greatest(o.s, me.s)) >= least(o.e - o.s, me.e - me.s)))) END
      FROM step st JOIN x me ON me.doc_id = st.doc_id AND me.k = st.k + 1)
    SELECT x.doc_id, x.word, x.s, x.e, x.source FROM x JOIN (SELECT doc_id, unnest(arg_max(kept, k)) AS k FROM step GROUP BY doc_id) f ON f.doc_id = x.doc_id AND f.k = x.k""",
)
def win5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("source") == "rule", 1).when(F.col("source") == "bert", 2).otherwise(3)
    spans = SPANS.df(spark).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", rank.alias("r"), "e", "word", "source"))).alias("xs"))
    unit = "struct<s:int,r:int,e:int,word:string,source:string>"
    overlap = "2 * (least(o.e, m.e) - greatest(o.s, m.s)) >= least(o.e - o.s, m.e - m.s)"
    priority = "CASE z.source WHEN 'bert' THEN 3 WHEN 'regex' THEN 2 ELSE 1 END"
    fold = f"""aggregate(sequence(1, size(xs)), named_struct('rest', xs, 'kept', CAST(array() AS array<{unit}>)), (a, i) -> CASE WHEN size(a.rest) = 0 THEN a ELSE
      element_at(transform(array(a.rest[0]), m -> named_struct('rest', filter(a.rest, (o, j) -> j > 0 AND NOT ({overlap})),
        'kept', concat(a.kept, array(array_max(transform(filter(a.rest, (o, j) -> j = 0 OR {overlap}), (z, j) -> named_struct('p', {priority}, 'j', -j, 'z', z))).z)))), 1) END).kept"""
    return spans.select("doc_id", F.explode(F.expr(fold)).alias("k")).select("doc_id", "k.word", "k.s", "k.e", "k.source")


@query("jn11_overlap_pairs", f"WITH x AS {SPANS.sql()} SELECT a.doc_id, a.word AS word1, b.word AS word2, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.source < b.source AND least(a.e, b.e) > greatest(a.s, b.s) AND 2 * (least(a.e, b.e) - greatest(a.s, b.s)) >= least(a.e - a.s, b.e - b.s)")
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = SPANS.df(spark)
    a, b = x.alias("a"), x.alias("b")
    shared = F.least("a.e", "b.e") - F.greatest("a.s", "b.s")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.source") < F.col("b.source")) & (shared > 0) & (2 * shared >= F.least(F.expr("a.e - a.s"), F.expr("b.e - b.s")))
    return a.join(b, on).select("a.doc_id", F.col("a.word").alias("word1"), F.col("b.word").alias("word2"), shared.alias("shared"))


PIECES = Inline("doc_id int, ord int, word string, s int, e int, score double", [(1, 0, "z", 0, 1, 0.9), (1, 1, ".", 1, 2, 0.8), (1, 2, "B.", 2, 4, 0.7), (1, 3, "usw", 10, 13, 0.95), (2, 0, "ca", 0, 2, 0.6), (2, 1, "Dr", 5, 7, 0.9), (2, 2, ".", 7, 8, 0.9)])


@query("win4_heal_fragments", f"SELECT doc_id, min(s) AS s, max(e) AS e, string_agg(word, '' ORDER BY s) AS word, avg(score) AS score, count(*) AS n FROM (SELECT *, sum(CASE WHEN s = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM {PIECES.sql()})) GROUP BY doc_id, g")
def win4(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("s")
    g = PIECES.df(spark).withColumn("p", F.lag("e").over(w)).withColumn("g", F.sum(F.when(F.col("s") == F.col("p"), 0).otherwise(1)).over(w))
    x = g.groupBy("doc_id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sort_array(F.collect_list(F.struct("ord", "word"))).alias("ws"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return x.select("doc_id", "s", "e", F.array_join(F.transform("ws", lambda y: y["word"]), "").alias("word"), "score", "n")


ISSUES = Inline("doc_id int, ord int, rule string, term string, start int, end int", [(1, 0, "genitiv", "des Hauses", 4, 14), (1, 1, "komposita", "Hauses", 8, 14), (1, 2, "satzlaenge", "", None, None), (1, 3, "negationen", "nicht", 20, 25), (1, 4, "kurze_woerter", "Hauses", 8, 14), (2, 0, "negationen", "kein", 0, 4), (2, 1, "negationen", "kein", 0, 4), (2, 2, "fremdwoerter", "Service", 5, 12), (3, 0, "unbekannt", "x", 1, 2)])
SENTENCES = Inline("doc_id int, sent_no int, start_char int, end_char int, text string", [(1, 1, 0, 10, "Satz eins."), (1, 2, 10, 22, " Satz zwei."), (1, 3, 22, 40, " Und ein dritter."), (2, 1, 0, 6, "Kein X"), (2, 2, 6, 20, "Ende hier.")])
_ISSUES_SQL = ISSUES.sql().replace("CAST(end AS", 'CAST("end" AS').replace(") AS end", ') AS "end"').replace(", end)", ', "end")')


@query("jn9_conflicts", f'WITH i AS {_ISSUES_SQL} SELECT a.doc_id, a.ord AS ord1, b.ord AS ord2 FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.ord < b.ord AND ((a.term <> \'\' AND a.term = b.term AND a.rule <> b.rule) OR coalesce(a."end" > b.start AND b."end" > a.start, false))')
def jn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations.conflicts(ISSUES.df(spark).withColumnRenamed("term", "text"))


@query("jn10_assign_to_sentences", f"""WITH i AS {_ISSUES_SQL}, s AS {SENTENCES.sql()} SELECT doc_id, ord, sent_no, overlap FROM (SELECT i.doc_id, i.ord, s.sent_no, least(i."end", s.end_char) - greatest(i.start, s.start_char) AS overlap, row_number() OVER (PARTITION BY i.doc_id, i.ord ORDER BY least(i."end", s.end_char) - greatest(i.start, s.start_char) DESC, s.sent_no) AS r
  FROM i JOIN s ON i.doc_id = s.doc_id AND i.start < s.end_char AND i."end" > s.start_char) WHERE r = 1""")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.assigned(ISSUES.df(spark), SENTENCES.df(spark))


_COST_SQL = "CASE " + " ".join(f"WHEN rule = '{r}' THEN {L.VIOLATION_COST[w]}" for r, w in L.RULE_WEIGHTS.items()) + " ELSE 1 END"
_WEIGHT_SQL = "CASE " + " ".join(f"WHEN rule = '{r}' THEN {w}" for r, w in L.RULE_WEIGHTS.items()) + " ELSE 15 END"


@query("jn18_rule_weight", f"SELECT doc_id, ord, rule, {_WEIGHT_SQL} AS weight, {_COST_SQL} AS cost FROM {_ISSUES_SQL}")
def jn18(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = violations.weight(F.col("rule"))
    return ISSUES.df(spark).select("doc_id", "ord", "rule", w.alias("weight"), violations.cost(w).alias("cost"))


@query("agg2_weighted_sum", f"SELECT doc_id, CAST(sum({_COST_SQL}) AS BIGINT) AS weighted FROM {_ISSUES_SQL} GROUP BY doc_id")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ISSUES.df(spark).groupBy("doc_id").agg(F.sum(violations.cost(violations.weight(F.col("rule")))).alias("weighted"))


@query("win8_group_by_position", f"""SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f, ord) AS INTEGER) AS place FROM (SELECT doc_id, ord, min(ord) OVER (PARTITION BY doc_id, CASE WHEN start IS NULL OR "end" IS NULL THEN 'o' || ord ELSE start || '-' || "end" END) AS f FROM {_ISSUES_SQL})""")
def win8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations.grouped_by_position(ISSUES.df(spark)).select("doc_id", "ord", "place")


@query("srt2_six_issues", f"SELECT doc_id, ord, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_WEIGHT_SQL}, ord) AS r FROM {_ISSUES_SQL}) WHERE r <= 6")
def srt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(violations.weight(F.col("rule")), "ord"))
    return ISSUES.df(spark).withColumn("r", rank).where("r <= 6").select("doc_id", "ord", "rule")


@query("agg7_failure_statistics", f"SELECT rule, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct, array_to_string(list_sort(list(DISTINCT term))[1:10], '|') AS examples FROM {_ISSUES_SQL} GROUP BY rule")
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ISSUES.df(spark).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("term")), 1, 10).alias("t"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return per.select("rule", "n", (F.col("n") * F.lit(100.0) / total).alias("pct"), F.array_join("t", "|").alias("examples"))


@query("aux16_learned_patterns", f"SELECT rule, count(*) AS n FROM {_ISSUES_SQL} GROUP BY rule HAVING count(*) >= 2")
def aux16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ISSUES.df(spark).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("aux15_rules_of_sentence", f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM {_ISSUES_SQL} GROUP BY doc_id")
def aux15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ISSUES.df(spark).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


ANNOTATE = Inline("doc_id int, text string, ord int, rule string, term string, end int", [(1, "Das Haus ist nicht alt.", 0, "negationen", "nicht", 18), (1, "Das Haus ist nicht alt.", 1, "kurze_woerter", "Haus", 8), (1, "Das Haus ist nicht alt.", 2, "satzlaenge", "alt", 22), (1, "Das Haus ist nicht alt.", 3, "genitiv", "nicht", 18), (2, "Kurz.", 0, "x", "Kurz", 4)])
_ANNOTATE_SQL = ANNOTATE.sql().replace("CAST(end AS", 'CAST("end" AS').replace(") AS end", ') AS "end"').replace(", end)", ', "end")')


@query(
    "win9_annotated_text",
    f"""WITH a AS {_ANNOTATE_SQL}, g AS (SELECT doc_id, any_value(text) AS text, "end" AS e, string_agg('[' || rule || ': ' || term || ']', '' ORDER BY ord) AS m FROM a GROUP BY doc_id, "end"),
    p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS b FROM g)
    SELECT doc_id, string_agg(substring(text, b + 1, e - b) || m, '' ORDER BY e) || substring(any_value(text), max(e) + 1) AS annotated FROM p GROUP BY doc_id""",
)
def win9(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ANNOTATE.df(spark).groupBy("doc_id", "text").agg(F.collect_list(F.struct("ord", "rule", "term", "end")).alias("marks"))
    return marks.select("doc_id", violations.annotated(F.col("text"), F.col("marks")).alias("annotated"))


STATES = Inline("doc_id int, idx int, original string, current string, weighted int, attempts int, status string", [(1, 0, "Satz eins. ", "Satz eins.", 3, 1, "open"), (1, 1, "Satz zwei.", "Neuer Satz.", 3, 0, "open"), (1, 2, "Satz drei.", " ", 9, 0, "done"), (2, 0, "A.", "A.", 0, 0, "open"), (2, 1, "B.", "B. ", 0, 2, "failed"), (3, 0, "C.", "D.", 1, 0, "open"), (3, 1, "E.", "E.", 5, 2, "open")])


@query("srt1_priority", f"SELECT doc_id, idx, weighted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weighted DESC, attempts, idx) AS r FROM {STATES.sql()} WHERE status = 'open' AND weighted > 0) WHERE r = 1")
def srt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.first_open(STATES.df(spark)).select("doc_id", "idx", "weighted")


@query("gen3_reassembled", f"SELECT doc_id, array_to_string(list_filter(list(trim(current) ORDER BY idx), lambda x: x <> ''), ' ') AS text, count(*) FILTER (WHERE trim(current) <> trim(original)) AS edits FROM {STATES.sql()} GROUP BY doc_id")
def gen3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.reassembled(STATES.df(spark))


@query("agg21_edits", f"SELECT doc_id, count(*) FILTER (WHERE trim(current) <> trim(original)) AS edits, CAST(sum(length(current)) AS DOUBLE) / sum(length(original)) AS ratio FROM {STATES.sql()} GROUP BY doc_id")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.df(spark).groupBy("doc_id").agg(F.count_if(T.strip(F.col("current")) != T.strip(F.col("original"))).alias("edits"), (F.sum(F.length("current")).cast("double") / F.sum(F.length("original"))).alias("ratio"))


@query("aux14_done_and_open", f"SELECT doc_id, count(*) FILTER (WHERE status = 'open' AND weighted = 0) AS n_fixed, bool_or(status = 'open' AND weighted > 0) AS any_open FROM {STATES.sql()} GROUP BY doc_id")
def aux14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.df(spark).groupBy("doc_id").agg(F.count_if(F.expr("status = 'open' AND weighted = 0")).alias("n_fixed"), F.bool_or(F.expr("status = 'open' AND weighted > 0")).alias("any_open"))


@query("gen4_candidate_weight", f"SELECT doc_id, CAST(coalesce(sum(CASE WHEN contains('A. B. Satz eins. E.', trim(original)) THEN weighted END), 0) AS BIGINT) AS w FROM {STATES.sql()} GROUP BY doc_id")
def gen4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.df(spark).groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.contains(F.lit("A. B. Satz eins. E."), T.strip(F.col("original"))), F.col("weighted"))), F.lit(0)).alias("w"))


RUNS = Inline(
    "provider string, model string, tier string, text_id string, words int, success boolean, final_violations int, iterations int, seconds double, faithfulness int, hix double",
    [("p", "m", "small", "t1", 30, True, 3, 2, 10.5, 4, 15.25), ("p", "m", "small", "t2", 35, False, -1, 0, 3.0, None, None), ("p", "m", "small", "t3", 80, True, 5, 3, 20.0, 5, 12.0), ("q", "n", "big", "t1", 30, True, 0, 1, 8.0, None, 18.5), ("q", "n", "big", "t3", 200, False, -1, 4, 99.0, 2, None), ("q", "n", "big", "t4", 120, True, 2, 2, 50.0, 3, 11.5)],
)
_BIN_SQL = "CASE WHEN words <= 40 THEN 'short' WHEN words <= 100 THEN 'medium' ELSE 'long' END"
_FLOOR = lambda x: f"floor({x} * 100 + 0.5::DOUBLE) / 100.0::DOUBLE"


@query("prj10_length_bin", f"SELECT text_id, provider, {_BIN_SQL} AS length_bin FROM {RUNS.sql()}")
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RUNS.df(spark).select("text_id", "provider", evaluation.length_bin(F.col("words")).alias("length_bin"))


@query("agg6_run_summary", f"SELECT provider, model, tier, {_BIN_SQL} AS length_bin, count(*) AS n, {_FLOOR('avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS success_rate, {_FLOOR('coalesce(avg(CASE WHEN final_violations >= 0 THEN final_violations::DOUBLE END), 0.0::DOUBLE)')} AS avg_violations, {_FLOOR('avg(iterations::DOUBLE)')} AS avg_iterations, {_FLOOR('avg(seconds)')} AS avg_seconds, {_FLOOR('avg(faithfulness::DOUBLE)')} AS avg_faithfulness, {_FLOOR('avg(hix)')} AS avg_hix FROM {RUNS.sql()} GROUP BY ALL")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(RUNS.df(spark).withColumn("length_bin", evaluation.length_bin(F.col("words"))))


@query("jn16_resume", f"WITH r AS {RUNS.sql()} SELECT m.provider, m.model, t.text_id FROM (SELECT DISTINCT provider, model FROM r) m CROSS JOIN (SELECT DISTINCT text_id FROM r) t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.provider = m.provider AND r.model = m.model AND r.text_id = t.text_id)")
def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = RUNS.df(spark)
    planned = evaluation.run_matrix(r.select("provider", "model").distinct(), r.select("text_id").distinct())
    return evaluation.remaining(planned, r)


@query("jn17_run_matrix", f"WITH r AS {RUNS.sql()} SELECT m.provider, m.model, t.text_id FROM (SELECT DISTINCT provider, model FROM r) m CROSS JOIN (SELECT DISTINCT text_id, {_BIN_SQL} AS b FROM r) t WHERE b <> 'long'")
def jn17(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = RUNS.df(spark)
    texts = r.select("text_id", evaluation.length_bin(F.col("words")).alias("b")).distinct().where("b <> 'long'").select("text_id")
    return evaluation.run_matrix(r.select("provider", "model").distinct(), texts)


@query("gen6_stop_reason", f"SELECT text_id, provider, CASE WHEN final_violations <= 3 AND (faithfulness IS NULL OR faithfulness >= 4) THEN 'success' WHEN seconds >= 50 THEN 'deadline' ELSE 'continue' END AS reason FROM {RUNS.sql()}")
def gen6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RUNS.df(spark).select("text_id", "provider", planner.stop_reason(F.col("final_violations"), 3, F.col("faithfulness"), F.col("seconds"), 50.0).alias("reason"))


@query("gen8_error_rows", f"SELECT provider, model, text_id, false AS success, -1 AS final_violations, CAST(NULL AS DOUBLE) AS hix FROM {RUNS.sql()} WHERE NOT success")
def gen8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RUNS.df(spark).where(~F.col("success")).select("provider", "model", "text_id", F.lit(False).alias("success"), F.lit(-1).alias("final_violations"), F.lit(None).cast("double").alias("hix"))


@query("win11_best_so_far", f"SELECT provider, arg_min(text_id, (final_violations, -coalesce(faithfulness, 0), text_id)) AS best FROM {RUNS.sql()} WHERE final_violations >= 0 GROUP BY provider")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("final_violations", (-F.coalesce("faithfulness", F.lit(0))).alias("f"), "text_id")
    return RUNS.df(spark).where("final_violations >= 0").groupBy("provider").agg(F.min_by("text_id", order).alias("best"))


@query("agg13_rollup_results", f"SELECT coalesce(provider, 'total') AS provider, count(*) FILTER (WHERE success) AS passed, count(*) FILTER (WHERE NOT success) AS failed FROM {RUNS.sql()} GROUP BY ROLLUP (provider)")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RUNS.df(spark).rollup("provider").agg(F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed")).select(F.coalesce("provider", F.lit("total")).alias("provider"), "passed", "failed")


METRICS = Inline("side string, metric string, value double", [("old", "f1", 0.8), ("old", "loss", 0.5), ("new", "f1", 0.85), ("new", "acc", 0.9)])


@query("jn20_compare_metrics", f"WITH m AS {METRICS.sql()} SELECT coalesce(a.metric, b.metric) AS metric, a.value AS old_value, b.value AS new_value, b.value - a.value AS delta FROM (SELECT * FROM m WHERE side = 'old') a FULL JOIN (SELECT * FROM m WHERE side = 'new') b ON a.metric = b.metric")
def jn20(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = METRICS.df(spark)
    a, b = m.where("side = 'old'").select("metric", F.col("value").alias("old_value")), m.where("side = 'new'").select("metric", F.col("value").alias("new_value"))
    return a.join(b, "metric", "full_outer").select("metric", "old_value", "new_value", (F.col("new_value") - F.col("old_value")).alias("delta"))


PREDICTIONS = Inline("id int, head string, label string, pred string", [(1, "case", "nom", "nom"), (2, "case", "nom", "acc"), (3, "case", "acc", "acc"), (4, "case", "dat", "acc"), (5, "number", "sg", "sg"), (6, "number", "pl", "sg"), (7, "number", "sg", "sg")])


@query("agg12_confusion", f"WITH p AS {PREDICTIONS.sql()}, k AS (SELECT label AS l FROM p UNION SELECT pred FROM p) SELECT l AS label, count(*) FILTER (WHERE label = l AND pred = l) AS tp, count(*) FILTER (WHERE label <> l AND pred = l) AS fp, count(*) FILTER (WHERE label = l AND pred <> l) AS fn, count(*) FILTER (WHERE label = l) AS support FROM k, p GROUP BY l")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(PREDICTIONS.df(spark))


@query("agg12_weighted_scores", f"""WITH p AS {PREDICTIONS.sql()}, k AS (SELECT label AS l FROM p UNION SELECT pred FROM p), c AS (SELECT l, count(*) FILTER (WHERE label = l AND pred = l) AS tp, count(*) FILTER (WHERE label <> l AND pred = l) AS fp, count(*) FILTER (WHERE label = l AND pred <> l) AS fn, count(*) FILTER (WHERE label = l) AS support FROM k, p GROUP BY l),
  s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS rc FROM c)
  SELECT sum(tp)::DOUBLE / sum(support) AS accuracy, sum(pr * support) / sum(support) AS weighted_precision, sum(rc * support) / sum(support) AS weighted_recall, sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support) AS weighted_f1 FROM s""")
def agg12w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.weighted_scores(evaluation.confusion(PREDICTIONS.df(spark)))


@query("aux21_head_accuracy", f"SELECT avg(a) AS accuracy FROM (SELECT head, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) AS a FROM {PREDICTIONS.sql()} GROUP BY head)")
def aux21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PREDICTIONS.df(spark).groupBy("head").agg(F.avg(F.when(F.col("label") == F.col("pred"), 1.0).otherwise(0.0)).alias("a")).agg(F.avg("a").alias("accuracy"))


@query("agg11_label_counters", f"SELECT head, label, count(*) AS n FROM {PREDICTIONS.sql()} GROUP BY head, label")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PREDICTIONS.df(spark).groupBy("head", "label").agg(F.count(F.lit(1)).alias("n"))


@query("trn3_label_vocabulary", f"SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT unnest(labels) AS label FROM {LABELS.sql()})")
def trn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.vocabulary(LABELS.df(spark), "labels")


@query("agg8_label_distribution", f"SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT unnest(labels) AS label FROM {LABELS.sql()}) GROUP BY label")
def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = LABELS.df(spark).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per.select("label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


ENCODED = Inline("id int, reflex string, label_id int", [(1, "True", 0), (2, "False", 1), (3, "true", 2)])


@query("trn4_label_decoding", f"SELECT id, lower(reflex) AS reflex, CASE label_id WHEN 0 THEN 'O' WHEN 1 THEN 'B-ABK' END AS label FROM {ENCODED.sql()}")
def trn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit(0), F.lit("O"), F.lit(1), F.lit("B-ABK"))
    return ENCODED.df(spark).select("id", F.lower("reflex").alias("reflex"), F.try_element_at(names, F.col("label_id")).alias("label"))


PERPLEXITY = Inline("id int, p double", [(1, 10.5), (2, 20.25), (3, None), (4, 3.0)])


@query("agg18_mean_perplexity", f"SELECT avg(p) AS mean_p, count(p) AS n FROM {PERPLEXITY.sql()} WHERE NOT isnan(p) AND p < 1e308")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PERPLEXITY.df(spark).where(~F.isnan("p") & (F.col("p") < 1e308)).agg(F.avg("p").alias("mean_p"), F.count("p").alias("n"))


LOGITS = Inline("id int, logits array<double>", [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0]), (3, [-5.0, 5.0])])


@query("scalar_softmax", f"SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS best, floor(exp(list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x))) * 1000000 + 0.5) / 1000000 AS confidence FROM {LOGITS.sql()}")
def scalar_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(F.transform("logits", F.exp), F.lit(0.0), lambda a, x: a + x)
    return LOGITS.df(spark).select("id", (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("best"), (F.floor(F.exp(F.array_max("logits")) / total * 1000000 + 0.5).cast("double") / 1000000).alias("confidence"))


ARTICLES = Inline("gender string, case_ string, number string, article string", [("m", "nom", "sg", "der"), ("f", "nom", "sg", "die"), ("n", "nom", "sg", "das"), ("m", "acc", "sg", "den"), ("m", "dat", "sg", "dem"), ("f", "dat", "sg", "der"), ("x", "nom", "pl", "die"), ("x", "dat", "pl", "den")])
NOUNS = Inline("noun string, gender string, case_ string, number string", [("Hund", "m", "acc", "sg"), ("Katze", "f", "gen", "sg"), ("Hunde", "m", "dat", "pl"), ("Ding", "n", "dat", "sg"), ("Wort", None, "nom", "sg")])


@query("jn19_articles", f"""WITH a AS {ARTICLES.sql()}, n AS {NOUNS.sql()} SELECT noun, coalesce(x.article, y.article, 'die') AS article FROM n LEFT JOIN a x ON x.case_ = n.case_ AND x.number = n.number AND x.gender = CASE WHEN n.number = 'pl' THEN 'x' ELSE n.gender END
  LEFT JOIN a y ON y.case_ = 'nom' AND y.number = n.number AND y.gender = CASE WHEN n.number = 'pl' THEN 'x' ELSE n.gender END""")
def jn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = ARTICLES.df(spark), NOUNS.df(spark).withColumn("g", F.expr("CASE WHEN number = 'pl' THEN 'x' ELSE gender END"))
    exact = F.broadcast(a.select(F.col("gender").alias("g"), "case_", "number", F.col("article").alias("a1")))
    fall = F.broadcast(a.where("case_ = 'nom'").select(F.col("gender").alias("g"), "number", F.col("article").alias("a2")))
    return n.join(exact, ["g", "case_", "number"], "left").join(fall, ["g", "number"], "left").select("noun", F.coalesce("a1", "a2", F.lit("die")).alias("article"))


FIELDS = Inline("field string, verbs array<string>", [("bewegung", ["gehen", "laufen", "kommen"]), ("sprechen", ["sagen", "reden", "fragen"])])
VERBS = Inline("sent int, verbs array<string>", [(1, ["gehen", "kommen", "sagen"]), (2, ["sagen", "essen"]), (3, ["reden", "fragen"])])


@query("set4_semantic_field", f"SELECT sent, min(field) AS field FROM {VERBS.sql()} v JOIN {FIELDS.sql()} f ON len(list_intersect(v.verbs, f.verbs)) >= 2 GROUP BY sent")
def set4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # verbs meet their fields by equality, so that no list is compared with every field
    v = VERBS.df(spark).select("sent", F.explode(F.array_distinct("verbs")).alias("verb"))
    f = FIELDS.df(spark).select("field", F.explode("verbs").alias("verb"))
    return v.join(F.broadcast(f), "verb").groupBy("sent", "field").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("sent").agg(F.min("field").alias("field"))


@query("set3_missing_keys", f"SELECT sent, array_to_string(list_sort(list_filter(verbs, lambda x: NOT list_contains(['gehen', 'sagen', 'reden'], x))), ',') AS missing FROM {VERBS.sql()}")
def set3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VERBS.df(spark).select("sent", F.array_join(F.array_sort(F.array_except("verbs", F.array(F.lit("gehen"), F.lit("sagen"), F.lit("reden")))), ",").alias("missing"))


@query("set5_allowed_characters", "SELECT CAST(count(DISTINCT c) AS BIGINT) AS n FROM (SELECT unnest(list_concat(['.', '?', '!', ':', '·', '•'], ['“', '”', '„', '‚', '‘', '’', '»', '«', '›', '‹'], [','])) AS c)")
def set5(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = lambda s: F.array(*(F.lit(c) for c in s))
    return spark.range(1).select(F.size(F.array_union(F.array_union(chars(L.ALLOWED_MARKS), chars(L.ALLOWED_QUOTES)), chars(","))).cast("long").alias("n"))


@query("jn14_shared_synsets", f"WITH w AS (SELECT DISTINCT lower(w) AS lemma, sid FROM (SELECT sid, unnest(words) AS w FROM {SYNSETS.sql()})) SELECT a.lemma AS w1, b.lemma AS w2, count(*) AS shared FROM w a JOIN w b ON a.sid = b.sid AND a.lemma < b.lemma GROUP BY 1, 2")
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = SYNSETS.df(spark).select("sid", F.explode("words").alias("w")).select("sid", F.lower("w").alias("lemma")).distinct()
    a, b = w.alias("a"), w.alias("b")
    return a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.lemma") < F.col("b.lemma"))).groupBy(F.col("a.lemma").alias("w1"), F.col("b.lemma").alias("w2")).agg(F.count(F.lit(1)).alias("shared"))


LISTS = Inline("id int, existing array<string>, added array<string>", [(1, ["Nicht", "kein"], ["nicht", "nie", "ohne", "kaum", "weder"]), (2, [], ["a", "A", "b"])])


@query("snk7_list_update", f"SELECT id, array_to_string(list_filter(added, lambda x: NOT list_contains(list_transform(existing, lambda y: lower(y)), lower(x)))[1:3], ',') AS appended FROM {LISTS.sql()}")
def snk7(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.filter("added", lambda x: ~F.array_contains(F.transform("existing", F.lower), F.lower(x)))
    return LISTS.df(spark).select("id", F.array_join(F.slice(new, 1, 3), ",").alias("appended"))


CANDIDATES = Inline("pron int, pos int, word string, w_pos int, number_ok boolean", [(1, 10, "Hund", 2, True), (1, 10, "Katzen", 6, False), (1, 10, "Ball", 8, True), (2, 3, "Frau", 1, True), (2, 3, "Mann", 5, True), (3, 1, "Kind", 4, True)])


@query("jn15_nearest_before", f"SELECT pron, coalesce(arg_max(word, w_pos) FILTER (WHERE w_pos < pos), arg_min(word, w_pos)) AS word FROM {CANDIDATES.sql()} GROUP BY pron")
def jn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.max_by(F.when(F.col("w_pos") < F.col("pos"), F.col("word")), F.when(F.col("w_pos") < F.col("pos"), F.col("w_pos")))
    return CANDIDATES.df(spark).groupBy("pron").agg(F.coalesce(before, F.min_by("word", "w_pos")).alias("word"))


@query("srt3_antecedents", f"SELECT pron, array_to_string(list(word ORDER BY abs(pos - w_pos), CASE WHEN w_pos < pos THEN 0 ELSE 1 END)[1:3], ',') AS words FROM {CANDIDATES.sql()} GROUP BY pron")
def srt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sort_array(F.collect_list(F.struct(F.abs(F.col("pos") - F.col("w_pos")).alias("d"), F.when(F.col("w_pos") < F.col("pos"), 0).otherwise(1).alias("b"), "word")))
    return CANDIDATES.df(spark).groupBy("pron").agg(order.alias("c")).select("pron", F.array_join(F.transform(F.slice("c", 1, 3), lambda x: x["word"]), ",").alias("words"))


@query("aux12_best_candidate", f"SELECT pron, arg_max(word, (CASE WHEN number_ok THEN 2 ELSE 0 END + CASE WHEN w_pos <= 2 THEN 1 ELSE 0 END, -w_pos)) AS best FROM {CANDIDATES.sql()} GROUP BY pron")
def aux12(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.struct((F.when(F.col("number_ok"), 2).otherwise(0) + F.when(F.col("w_pos") <= 2, 1).otherwise(0)).alias("s"), (-F.col("w_pos")).alias("p"))
    return CANDIDATES.df(spark).groupBy("pron").agg(F.max_by("word", score).alias("best"))


@query("aux1_rule_catalogue", "SELECT rule, weight, cost FROM (VALUES " + ", ".join(f"('{r}', {w}, {L.VIOLATION_COST[w]})" for r, w in L.RULE_WEIGHTS.items()) + ") t(rule, weight, cost)")
def aux1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r,) for r in sorted(L.RULE_WEIGHTS)], "rule string")
    w = violations.weight(F.col("rule"))
    return rules.select("rule", w.alias("weight"), violations.cost(w).alias("cost"))


SUBWORDS = Inline("word int, pieces array<string>, label string", [(0, ["Bun", "##des"], "B-ABK"), (1, ["z"], "O"), (2, ["a", "##b", "##c"], "I-ABK")])


@query("tok11_subword_labels", f"SELECT word, CAST(k - 1 AS INTEGER) AS k, piece, CASE WHEN k = 1 THEN label ELSE '-100' END AS label FROM (SELECT word, label, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM {SUBWORDS.sql()})")
def tok11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SUBWORDS.df(spark).select("word", "label", F.posexplode("pieces").alias("k", "piece")).select("word", "k", "piece", F.when(F.col("k") == 0, F.col("label")).otherwise("-100").alias("label"))


@query("aux20_offset_mask", f"SELECT word, CAST(coalesce(sum(len(pieces) + 1) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM {SUBWORDS.sql()}")
def aux20(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return SUBWORDS.df(spark).select("word", F.coalesce(F.sum(F.size("pieces") + 1).over(w), F.lit(0)).cast("long").alias("at"))
