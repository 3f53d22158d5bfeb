"""Queries on what surrounds the rules: discovery, records and files of a service, rewriting, detectors, ablation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotate, rewriting, rules, violations
from ..operators.annotate import Annotated
from ..operators.joins import SENT_ROWS
from ..sources import readers, sinks
from ..sources.folders import through_folder
from .registry import Inline, query, table

_FILES = {
    "negationen/flag_nicht.txt": "# expected: flag\n# description: Partikel\n\nDas ist nicht gut.",
    "negationen/pass_gut.txt": "# expected: pass\n\nDas ist gut.",
    "genitiv/flag_des.txt": "# expected: flag\n\nDas Dach des Hauses.",
    "satzlaenge/notes.md": "no fixture",
}


def _put_all(spark: SparkSession, files: dict[str, str]) -> str:
    at = sinks.shared_folder(spark)
    for name, content in files.items():
        sinks.put(spark, f"{at}/{name}", content.encode())
    return at


_FIXTURE_ROWS = Inline("k int, rule string, name string, expected string, description string, text string", [(1, "genitiv", "flag_des", "flag", None, "Das Dach des Hauses."), (2, "negationen", "flag_nicht", "flag", "Partikel", "Das ist nicht gut."), (3, "negationen", "pass_gut", "pass", None, "Das ist gut.")])


@query("src3_fixture_discovery", f"SELECT * FROM {_FIXTURE_ROWS.sql()}")
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.fixtures(spark, _put_all(spark, _FILES))
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rule", "name"))  # a folder of fixtures
    return found.select(k.alias("k"), "rule", "name", "expected", "description", "text")


@query("src5_jsonl_blank_lines", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a line each with blank lines between them."""
    at = sinks.shared_folder(spark)
    records = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("value"))
    records.select(F.explode(F.array(F.col("value"), F.lit(""), F.lit("  "))).alias("value")).write.text(at)
    rows = readers.jsonl(spark, at, "conv_id long, turn long, role string, text string").where("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("digest"))


_ITEMS = Inline("sentence_id int, token_id int, token string", [(1, 0, "Er"), (1, 3, "sie"), (2, 1, "Zeile\nzwei"), (3, 2, None)])


@query("src7_json_array", f"SELECT * FROM {_ITEMS.sql()}")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("sentence_id", "token_id", "token")
    at = _put_all(spark, {"rows.json": json.dumps([dict(zip(names, r, strict=True)) for r in _ITEMS.rows], indent=2)})
    return readers.json_array(spark, at, _ITEMS.schema).select(*names)


_MODELS = {"a.bin": "weights a", "b.bin": "weights b, damaged", "d.bin": "not listed"}
_MANIFEST = Inline("name string, content string", [("a.bin", "weights a"), ("b.bin", "weights b"), ("c.bin", "never fetched")])


@query("src13_manifest", f"SELECT name, sha256(content) AS sha256, name = 'a.bin' AS ok FROM {_MANIFEST.sql()}")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _MANIFEST.df(spark).select("name", F.sha2("content", 256).alias("sha256"))
    return readers.verified(spark, _put_all(spark, _MODELS), manifest).select("name", "sha256", "ok")


_TREE = {"genitiv/rule.toml": "x", "konjunktiv/rule.toml": "x", "konjunktiv/train.toml": "x", "docs/readme.md": "x", "zahlwoerter/train.toml": "x"}


@query("src14_rule_discovery", "SELECT * FROM (VALUES ('genitiv', false), ('konjunktiv', true)) t(rule, trainable)")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.discovered(spark, _put_all(spark, _TREE), "rule.toml", "train.toml")


@query("snk3_summary_csv", "SELECT event_type, count(*) AS n, CAST(floor(sum(value) * 100 + 0.5::DOUBLE) AS BIGINT) AS cents FROM events GROUP BY event_type")
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.shared_folder(spark)
    cents = F.floor(F.sum(F.col("value").cast("decimal(38,12)")) * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    sinks.summary_csv(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), cents.alias("cents")).orderBy("event_type"), at)
    return spark.read.schema("event_type string, n long, cents long").option("header", True).csv(at)


@query("snk6_jsonl_conversion", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'), '|')) AS digest FROM documents")
def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents converted into records of tokens, one a line, and read again."""
    at = sinks.shared_folder(spark)
    tokens = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    sinks.append_jsonl(table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens")), at)
    rows = readers.jsonl(spark, at, "doc_id long, tokens array<string>")
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.encode(F.array_join("tokens", "|"), "UTF-8")).alias("digest"))


@query("snk8_promotion", "SELECT 'live' AS which, count(*) AS n FROM labels WHERE quality = 1 UNION ALL SELECT 'kept', count(*) FROM labels")
def snk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, labels = sinks.shared_folder(spark), table(spark, sf_dir, "labels")
    labels.write.parquet(f"{at}/live")
    labels.where("quality = 1").write.parquet(f"{at}/staged")
    kept = sinks.promote(spark, f"{at}/staged", f"{at}/live", "20260101-000000")
    count = lambda path, which: spark.read.parquet(path).agg(F.lit(which).alias("which"), F.count(F.lit(1)).alias("n"))
    return count(f"{at}/live", "live").unionByName(count(kept, "kept"))


METRICS = Inline("metric string, deployed double, staged double", [("f1", 0.9, 0.925), ("precision", 0.95, 0.95), ("recall", 0.5, 0.25), ("loss", None, 0.125)])


@query("snk10_comparison_table", f"SELECT rpad(metric, 12, ' ') || ' ' || coalesce(lpad(printf('%.4f', deployed), 8, ' '), '       -') || ' ' || coalesce(lpad(printf('%.4f', staged), 8, ' '), '       -') || ' ' || coalesce(lpad(printf('%+.4f', staged - deployed), 8, ' '), '       -') AS line FROM {METRICS.sql()}")
def snk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c, f="%.4f": F.coalesce(F.lpad(F.when(c.isNotNull(), F.format_string(f, c)), 8, " "), F.lit("       -"))
    change = F.col("staged") - F.col("deployed")
    return METRICS.df(spark).select(F.concat_ws(" ", F.rpad("metric", 12, " "), number(F.col("deployed")), number(F.col("staged")), number(change, "%+.4f")).alias("line"))


_SHORT = r"\(([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß0-9-]{1,8})\)"


@query("prj20_explained_abbreviations", f"WITH {annotate.TOKENS_SQL}, e AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_SHORT}', 1))) AS short FROM documents) SELECT e.doc_id, short, count(tok.lower) AS n FROM e LEFT JOIN tok ON tok.doc_id = e.doc_id AND tok.lower = short GROUP BY e.doc_id, short")
def prj20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations that a document explains, and how often it uses them: findings on these are dropped."""
    docs = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all("text", F.lit(_SHORT), F.lit(1))
    e = through_folder(docs.select("doc_id", F.explode(F.transform(found, lambda x: F.lower(x))).alias("short")).distinct(), "explained")
    # only texts of documents that explain something are cut into tokens
    ids = e.select("doc_id").distinct()
    t = Annotated(docs.join(F.broadcast(ids) if ids.count() <= SENT_ROWS else ids, "doc_id", "left_semi")).tokens.select("doc_id", F.col("lower").alias("short"))
    used = t.join(e, ["doc_id", "short"], "left_semi").groupBy("doc_id", "short").agg(F.count(F.lit(1)).alias("n"))
    return e.join(used, ["doc_id", "short"], "left").select("doc_id", "short", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


FRAGMENTS = Inline("doc_id int, s int, e int, score double", [(1, 0, 4, 0.5), (1, 4, 7, 1.0), (1, 9, 12, 0.75), (2, 3, 5, 0.25), (2, 5, 6, 0.5), (2, 6, 9, 0.75)])


@query("agg15_mean_confidence", f"SELECT doc_id, min(s) AS s, max(e) AS e, avg(score) AS confidence FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY s) = s THEN 0 ELSE 1 END AS new FROM {FRAGMENTS.sql()})) GROUP BY doc_id, run")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("s")
    runs = FRAGMENTS.df(spark).withColumn("new", F.when(F.lag("e").over(w) == F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.avg("score").alias("confidence")).drop("run")


_CACHE = 2


@query("srt9_lru_hits", f"""WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), p AS (SELECT *, lag(k) OVER (PARTITION BY user_id, event_type ORDER BY k) AS before FROM x),
h AS (SELECT p.user_id, p.k, count(DISTINCT b.event_type) AS others FROM p JOIN x b ON b.user_id = p.user_id AND b.k > p.before AND b.k < p.k GROUP BY p.user_id, p.k)
SELECT p.user_id, count(*) AS n, count(*) FILTER (WHERE before IS NOT NULL AND coalesce(others, 0) < {_CACHE}) AS hits FROM p LEFT JOIN h ON h.user_id = p.user_id AND h.k = p.k GROUP BY p.user_id""")
def srt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a least-recently-used cache with two places for each user's requests: the same as the one before, or as the run of equal ones before the last."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("again", F.coalesce(F.lag("event_type").over(w) == F.col("event_type"), F.lit(False)))
    # a run's first request: hit if the run before the last one was of its kind
    runs = e.where("NOT again").withColumn("back", F.coalesce(F.lag("event_type", 2).over(w) == F.col("event_type"), F.lit(False)))
    hits = runs.groupBy("user_id").agg(F.count_if("back").alias("first_hits"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("hits")).join(hits, "user_id").select("user_id", "n", (F.col("hits") + F.col("first_hits")).alias("hits"))


#: What a message of the passive rule begins with -> the detector that says it.
_DETECTORS = {"Passivähnliches": "adjektiv", "Passiv in": "werden", "Passiv mit": "modal", "Passiversatz": "ersatz", "Passiv \"": "perfekt", "Zustandspassiv": "zustand"}


@query("aux6_passive_dispatcher", f"SELECT doc_id, sent_no, CASE {' '.join(f"WHEN starts_with(message, '{k}') THEN '{v}'" for k, v in _DETECTORS.items())} END AS detector, count(*) AS n FROM ({rules.rule_sql('passiv_erkennung')}) GROUP BY ALL")
def aux6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which detectors of passives find something in a sentence."""
    v = rules.check_rule(Annotated(table(spark, sf_dir, "documents")), "passiv_erkennung")
    name = F.coalesce(*(F.when(F.startswith("message", F.lit(k)), v) for k, v in _DETECTORS.items()))
    return v.groupBy("doc_id", "sent_no", name.alias("detector")).agg(F.count(F.lit(1)).alias("n"))


@query("aux9_word_ablation", f"""WITH {annotate.TOKENS_SQL}, w AS (SELECT doc_id, sent_no, i, lower, n_syll, count(*) OVER s AS n, sum(n_syll) OVER s AS total, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY n_syll DESC, i) AS r FROM tok WHERE kind = 'w' WINDOW s AS (PARTITION BY doc_id, sent_no))
SELECT doc_id, sent_no, i, lower, total / n::DOUBLE - (total - n_syll) / (n - 1)::DOUBLE AS effect FROM w WHERE r = 1 AND n > 1""")
def aux9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word of each sentence whose removal lowers the mean number of syllables most, and by how much."""
    words = F.filter("ts", lambda t: t["kind"] == "w")
    s = Annotated(table(spark, sf_dir, "documents")).arrays.select("doc_id", "sent_no", words.alias("ws")).where(F.size("ws") > 1)
    top = F.array_max(F.transform("ws", lambda t: F.struct(t["n_syll"].alias("n_syll"), (-t["i"]).alias("back"), t["lower"].alias("lower"))))
    total = F.aggregate("ws", F.lit(0), lambda a, t: a + t["n_syll"])
    s = s.select("doc_id", "sent_no", F.size("ws").cast("double").alias("n"), total.cast("double").alias("total"), top.alias("t"))
    return s.select("doc_id", "sent_no", (-F.col("t.back")).alias("i"), "t.lower", (F.col("total") / F.col("n") - (F.col("total") - F.col("t.n_syll")) / (F.col("n") - 1)).alias("effect"))


@query("gen2_refined_sentences")
def gen2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all sentences after three rounds of rewriting. (Tests hold them against rewriting by hand.)"""
    return rewriting.refined(table(spark, sf_dir, "documents"))


@query("gen1_rewritten_documents")
def gen1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.rewritten(table(spark, sf_dir, "documents"))


@query("aux18_evaluation_run", f"""{rules.violations_sql()}, c AS (SELECT doc_id, rule, count(*) AS n FROM v GROUP BY doc_id, rule) SELECT lang, rule, count(*) AS docs, CAST(sum(n) AS BIGINT) AS violations, max(n) AS most FROM c JOIN documents USING (doc_id) GROUP BY lang, rule""")
def aux18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation run: violations of all texts by language and rule."""
    per = violations.statistics(table(spark, sf_dir, "documents"), keep=("lang",)).select("lang", F.explode("by_rule").alias("rule", "n"))
    return per.groupBy("lang", "rule").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("violations"), F.max("n").alias("most"))
