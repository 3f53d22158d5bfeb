"""Rules on sentences written for them, and edge inputs."""

import pytest

from lucidtext.functions import lexicons as L
from lucidtext.operators import annotate, planner, rules, violations
from lucidtext.operators.annotate import Annotated

CASES = [
    ("satzlaenge", "Der alte Mann geht mit seinem kleinen Hund an jedem Morgen durch den großen Park.", "Der Mann geht."),
    ("nebensaetze", "Ich bleibe, weil es regnet.", "Ich bleibe."),
    ("passiv_erkennung", "Der Antrag wird morgen geprüft.", "Wir prüfen den Antrag."),
    ("fremdwoerter", "Die Administration hilft.", "Das Amt hilft."),
    ("komposita", "Die Krankenversicherung zahlt.", "Die Kasse zahlt."),
    ("kurze_woerter", "Die Unabhängigkeitserklärung ist da.", "Das Haus ist da."),
    ("komplexitaet", "Die Globalisierungstendenz steigt.", "Der Ball rollt."),
    ("negationen", "Das ist nicht gut.", "Das ist gut."),
    ("redewendungen", "Er will das handtuch werfen.", "Er hört auf."),
    ("personalpronomen", "Da kann man viel tun.", "Da kann Anna viel tun."),
    ("zahlwoerter", "Ich habe zwei Kinder.", "Ich habe 2 Kinder."),
    ("abkuerzungen", "Das ist ca. 3 Meter.", "Das ist etwa 3 Meter."),
    ("interpunktion", "Das kostet 3 €; gut.", "Das kostet 3 Euro."),
    ("genitiv", "Das Dach des Hauses ist rot.", "Das Dach vom Haus ist rot."),
    ("konjunktiv", "Das wäre schön.", "Das ist schön."),
    ("perplexity_saetze", "Wir bleiben hier, obwohl es regnet.", "Wir bleiben hier."),
    ("mehrere_aussagen", "Wir kaufen Brot, wir kaufen Milch, wir gehen.", "Wir kaufen Brot."),
    ("synonyme", "Das Fahrzeug ist rot. Ein Auto ist blau.", "Das Auto ist rot."),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(2 * i + k, text) for i, (_, flag, ok) in enumerate(CASES) for k, text in enumerate((flag, ok))], "doc_id long, text string")
    return {(r.doc_id, r.rule) for r in rules.violations(Annotated(docs)).select("doc_id", "rule").distinct().collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_flag_and_pass(found, i):
    assert (2 * i, CASES[i][0]) in found
    assert (2 * i + 1, CASES[i][0]) not in found


def test_every_rule_has_a_plan(spark):
    a = Annotated(spark.createDataFrame([(1, "Ein Satz.")], "doc_id long, text string"))
    for rule in rules.RULES:
        assert tuple(rules.check_rule(a, rule).columns) == rules.COLUMNS
    assert set(rules.RULES) == set(L.RULE_WEIGHTS)


@pytest.mark.parametrize("text", ["", None, " \n\t ", "...", "!?!", "a" * 5000, "Zeile\r\nZeile", "x y", "„Zitat“", "Ümläut-ß-Wörter. 🙂"])
def test_edge_texts(spark, text):
    a = Annotated(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for t in a.tokens.collect():
        assert text[t.t_start : t.t_end] == t.text
    for s in a.sentences.collect():
        assert text[s.start_char : s.end_char] == s.text
    rules.violations(a).collect()


def test_first_use_expands_abbreviation(spark):
    docs = spark.createDataFrame([(1, "Der Doktor (Dr) kommt. Dr. Meier ist da."), (2, "Dr. Meier ist da.")], "doc_id long, text string")
    assert [r.doc_id for r in rules.check_rule(Annotated(docs), "abkuerzungen").collect()] == [2]


def test_statistics_add_up(spark):
    docs = spark.createDataFrame([(1, "Das ist nicht gut. Das ist nicht schlecht.")], "doc_id long, text string")
    v = rules.violations(Annotated(docs)).cache()
    s = violations.statistics(docs).collect()[0]
    assert s.total == v.count() == sum(s.by_rule.values())
    assert s.unique == v.select("rule", "term").distinct().count()


REPEATED = [(1, "Keine Administration.", "a"), (1, "Das ist nicht gut.", "b"), (1, "Das ist nicht gut.", None), (None, "Kein Problem. Nie!", "c"), (None, None, "d"), (None, "Das Haus ist rot.", "e"), (2, "", "f")]


def by_itself(spark, text):
    return rules.violations(Annotated(spark.createDataFrame([(7, text)], "doc_id long, text string"))).collect() if text else []


def test_rows_of_one_id_stay_apart(spark):
    """Statistics and annotated texts of each row are those of a table with that row alone."""
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string, tag string").coalesce(1)
    stats, marked = [], []
    for doc_id, text, tag in REPEATED:
        own = by_itself(spark, text)
        by_rule = {}
        for v in own:
            by_rule[v.rule] = by_rule.get(v.rule, 0) + 1
        if own:
            stats.append((doc_id, tag, len(own), len({(v.rule, v.term) for v in own}), sorted(by_rule.items()), sum(L.VIOLATION_COST[L.RULE_WEIGHTS[v.rule]] for v in own)))
        out = text
        for v in sorted((v for v in own if v.t_end is not None), key=lambda v: (v.t_end, v.t_start, v.rule, v.term, v.message), reverse=True):
            out = out[: v.t_end] + f"[{v.rule}: {v.term}]" + out[v.t_end :]
        marked.append((doc_id, tag, out))
    got = violations.statistics(docs, keep=("tag",)).collect()
    assert sorted(map(repr, stats)) == sorted(repr((r.doc_id, r.tag, r.total, r.unique, sorted(r.by_rule.items()), r.weighted)) for r in got)
    assert sorted(map(repr, marked)) == sorted(repr((r.doc_id, r.tag, r.annotated)) for r in violations.annotated_documents(docs, keep=("tag",)).collect())


def test_statistics_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(annotate, "BATCH_BYTES", 200)
    docs = spark.createDataFrame([(k % 5, f"Nein. Das ist nicht gut, {'nie ' * (k % 7)}.") for k in range(60)], "doc_id long, text string")
    assert violations.statistics(docs).count() == 60
    total = violations.statistics(docs).agg({"total": "sum"}).collect()[0][0]
    assert total == rules.violations(Annotated(docs)).count()


def test_detectors_of_passives_have_names(spark, tmp_path):
    from lucidtext.plans import queries

    text = "Der Antrag wird geprüft. Der Antrag muss geprüft werden. Das ist machbar. Die Tür ist geöffnet. Das lässt sich lösen. Er ist geprüft worden."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.sent_no, r.detector) for r in queries.queries()["aux6_passive_dispatcher"](spark, str(tmp_path)).collect()}
    assert {(1, "werden"), (2, "modal"), (3, "adjektiv"), (4, "zustand"), (5, "ersatz"), (6, "perfekt")} <= got and {d for _, d in got} <= {"adjektiv", "werden", "modal", "ersatz", "perfekt", "zustand"}


def test_similarity_is_difflib_ratio(spark):
    import difflib

    pairs = [("Ein Satz hier.", "Ein Satz da."), ("", "x"), ("gleich", "gleich")]
    got = spark.createDataFrame(pairs, "a string, b string").select(planner.similarity("a", "b").alias("s")).collect()
    assert [r.s for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


def test_sentences_cover_text(spark):
    text = "Eins. Zwei!  Drei? ... Vier"
    s = annotate.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sent_no").collect()
    assert "".join(x.text for x in s).replace(" ", "") == text.replace(" ", "")


def test_metaphors_are_looked_for_without_classes_of_letters(spark):
    """Such classes made the scan for whole metaphors take most of the rule's time; what may be one is judged after it."""
    assert "\\p{" not in rules.wanted(("redewendungen",)).cased
    texts = ["Das HERZ\tist Älter geworden.", "Das Holzherz ist alt.", "(Feuer  brennt)", "Sein Blick: Tellerrand schauen.", "Die Türen öffnen sich, Mosaikstein.", "herz ist."]
    got = rules.check_rule(Annotated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "redewendungen")
    assert {(r.doc_id, r.term) for r in got.collect()} == {(0, "herz\tist älter"), (2, "feuer  brennt"), (3, "tellerrand schauen"), (4, "türen öffnen"), (4, "mosaikstein")}


def test_weights_are_those_of_statistics_of_every_row(spark):
    """No message is made and no row lost; nothing is shuffled."""
    from lucidtext.operators import violations

    texts = ["Die Administration hilft!!", "Das Haus ist rot.", "Wir gehen, und sie gehen, und alle Leute gehen heute zusammen nach Hause.", "Das Haus des Mannes wird nicht ohne Geduld gebaut ... siehe www.haus.de", None, "", " ", "Man hat Annas Haus und das Bild der Katze (EU) gesehen, aber das ist kaum der Rede wert und Ärger liegt schwer im Magen."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.weighted for r in violations.statistics(docs).collect()}
    out = violations.weights(docs, ("doc_id",))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobinPartitioning", "").replace("Exchange SinglePartition", "")
    got = {r.doc_id: (r.text, r.weighted) for r in out.collect()}
    assert got == {k: (t, want.get(k, 0)) for k, t in enumerate(texts)}
    assert sum(w > 0 for _, w in got.values()) >= 4


def test_long_sentences_have_no_stack_to_overflow(spark):
    """A clause of very many words behind a comma or "und" is one match; Java's recursion over its words ended the executor."""
    more = "wort " * 20_000
    texts = [f"Es regnet und macht {more}.", f"Es regnet, aber {more}, und stürmt {more}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.term) for r in rules.check_rule(Annotated(docs), "mehrere_aussagen").where("message LIKE 'Zweite Aussage%'").collect()}
    assert got == {(0, f"und macht {more}".strip()), (1, f", aber {more}".strip()), (1, f"und stürmt {more}".strip())}
    assert {r.doc_id for r in violations.statistics(docs).collect()} == {0, 1}
    assert all(r.weighted > 0 for r in violations.weights(docs, ("doc_id",)).collect())


def test_patterns_for_spark_find_the_same(spark):
    """Groups that keep what they took, against the patterns as SQL has them."""
    import itertools
    import re

    parts = ("und", "geht", "t", ",", "aber", "der", "x", ".")
    joined = [f" {' '.join(x)} " for x in itertools.product(parts, repeat=5)]
    for rule, column, pattern, *_ in rules.PATTERN_RULES:
        if rules.spark_pattern(pattern) != pattern:
            assert (rule, column) == ("mehrere_aussagen", "joined")
            df = spark.createDataFrame([(x,) for x in joined], "j string")
            got = df.selectExpr("j", f"regexp_extract_all(j, r'{rules.spark_pattern(pattern)}', 0) AS m").collect()
            assert all(r.m == re.findall(pattern, r.j) for r in got) and any(r.m for r in got)
