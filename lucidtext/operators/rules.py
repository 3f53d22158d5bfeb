"""The eighteen rules, from one pass over the texts (``findings``).

A rule is one or several declarations: a predicate over words, and what must stand beside them; a predicate over a
sentence's counts; a pattern in a sentence's words or text; a pattern in the whole text; or a first occurrence, a
count or a pair within a document. All rules give the same columns: doc_id, rule, sent_no, t_start, t_end, term, message.

Predicates are SQL in the part that Spark and DuckDB share; ``rx(a, 'p')`` stands for
a regular-expression search. Those over words are evaluated on Arrow columns, once for each distinct word of a batch
(``functions.predicates``). Rules that need a parser work on closed word classes and
word shapes instead (tier 1); they are approximations and say so in ``TIERS``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .annotate import TOKENS_SQL, Annotated
from .findings import Wanted, findings
from .phrases import windows_sql

COLUMNS = ("doc_id", "rule", "sent_no", "t_start", "t_end", "term", "message")

#: 0: exact on regex tokens; 1: closed classes and shapes instead of a parser.
TIERS = {
    "abkuerzungen": 1, "fremdwoerter": 1, "genitiv": 1, "interpunktion": 0, "komplexitaet": 0, "komposita": 1, "konjunktiv": 1,
    "kurze_woerter": 0, "mehrere_aussagen": 1, "nebensaetze": 1, "negationen": 1, "passiv_erkennung": 1, "perplexity_saetze": 1,
    "personalpronomen": 1, "redewendungen": 0, "satzlaenge": 1, "synonyme": 1, "zahlwoerter": 0,
}


def _in(column: str, words) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


def _alt(words) -> str:
    return "(" + "|".join(words) + ")"


def spark_sql(text: str) -> str:
    """Shared SQL for Spark."""
    return re.sub(r"\brx\(", "regexp_like(", text)


def duck_sql(text: str) -> str:
    """Shared SQL for DuckDB."""
    return re.sub(r"\brx\(", "regexp_matches(", text)


def spark_pattern(pattern: str) -> str:
    """A pattern for Spark, in which a group that ends it and is repeated without bound keeps what it took. The rows are the same, but Java goes back and forth in such a
    group by recursion, and a sentence of a few thousand words overflows the stack, which ends the executor."""
    return re.sub(r"\)(\+|\{\d+,\})(?=$|\||\))", r")\1+", pattern)


def unicode_pattern(pattern: str) -> str:
    """A pattern that begins at a word's edge, for engines that know ASCII words only; its first group is what is found."""
    letter = r"\p{L}\p{N}_"
    return rf"(?:^|[^{letter}])(" + re.sub(r"\((?!\?)", "(?:", pattern.removeprefix(r"\b")).replace(r"\w", f"[{letter}]") + ")"


def loose_pattern(pattern: str) -> str:
    """What a text must hold for ``unicode_pattern`` to be found: without the word's edge and classes of all letters, which make a scan very slow."""
    return re.sub(r"\((?!\?)", "(?:", pattern.removeprefix(r"\b")).removesuffix(r"\w+")


_WORD = "kind = 'w'"
_CAPITAL = "rx(text, '^[A-ZÄÖÜ]')"
_MORPH = (
    f"rx(lower, '^{_alt(L.MORPH_PREFIXES)}') AND rx(lower, '{_alt(L.MORPH_SUFFIXES)}$') AND rx(lower, '{_alt(L.MORPH_FOREIGN)}')"
)
#: A word that is too long: more than 3 syllables (4 with a hyphen), more than 12 characters, or complex in all three ways.
LONG = f"(n_syll > {L.MAX_SYLLABLES} + (CASE WHEN text LIKE '%-%' THEN 1 ELSE 0 END) OR length(text) > {L.MAX_CHARS} OR ({_MORPH}))"
COUNTED = f"({_WORD} AND length(text) >= 4)"


def foreign_score(word: str = "lower", capital: str = _CAPITAL) -> str:
    """Shared SQL: how foreign a word looks."""
    endings = " + ".join(f"(CASE WHEN rx({word}, '{_alt(e)}$') THEN {int(s * 10)} ELSE 0 END)" for s, e in L.FOREIGN_ENDINGS)
    greek = " OR ".join(f"rx({word}, '^{p}')" for p in L.GREEK_STEMS)
    return f"((CASE WHEN n_syll >= 4 THEN 3 ELSE 0 END) + {endings} + (CASE WHEN {greek} THEN 5 ELSE 0 END) + (CASE WHEN {capital} AND length({word}) > 8 THEN 2 ELSE 0 END))"


def complexity_bonus() -> str:
    """Shared SQL: morphological complexity in tenths."""
    suffix = " OR ".join(f"(length(lower) > {len(x) + 3} AND rx(lower, '{x}$'))" for x in L.COMPLEX_SUFFIXES)
    prefix = " OR ".join(f"(length(lower) > {len(x) + 4} AND rx(lower, '^{x}'))" for x in L.COMPLEX_PREFIXES)
    return f"((CASE WHEN length(text) > 15 THEN 15 WHEN length(text) > 12 THEN 8 ELSE 0 END) + (CASE WHEN {suffix} THEN 10 ELSE 0 END) + (CASE WHEN {prefix} THEN 5 ELSE 0 END))"


_COMPLEX = tuple(w for w, *_ in L.COMPLEX_WORDS)


def _told(group: int) -> str:
    """Shared SQL: the plainer words (1) or the category (2) of a complex word, looked up in the list as one text."""
    text = "".join(f" {w}={plain}:{category};" for w, plain, category in L.COMPLEX_WORDS)
    return f"regexp_extract('{text}', concat(' ', lower, '=([^:]*):([^;]*);'), {group})"


#: (rule, predicate over words, what must hold besides of the token and its neighbours, message)
TOKEN_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("kurze_woerter", f"{COUNTED} AND {LONG}", "", "concat(CASE WHEN n_syll >= 6 THEN 'Sehr langes Wort' WHEN n_syll >= 4 THEN 'Langes Wort' ELSE 'Etwas langes Wort' END, ' \"', text, '\" (', n_syll, ' Silben, ', length(text), ' Zeichen).')"),
    ("komposita", f"{_WORD} AND {_CAPITAL} AND length(text) >= 12 AND text NOT LIKE '%-%'", "", "concat(CASE WHEN length(text) > 25 THEN 'Sehr langes Kompositum' WHEN length(text) > 20 THEN 'Langes Kompositum' ELSE 'Komplexes Kompositum' END, ' \"', text, '\" (', CASE WHEN length(text) > 25 THEN 'sehr hoch' WHEN length(text) > 20 THEN 'hoch' ELSE 'mittel' END, ').')"),
    ("komplexitaet", f"{_WORD} AND {_in('lower', _COMPLEX)}", "", f"concat({_told(2)}, ': \"', text, '\" (', {_told(2)}, ': bekanntes schwieriges Wort). Besser: \"', {_told(1)}, '\"')"),
    ("komplexitaet", f"{_WORD} AND length(text) >= 3 AND {complexity_bonus()} >= 10 AND NOT {_in('lower', (*L.SIMPLE_WORDS, *_COMPLEX))}", "", f"concat('Komplexes Wort \"', text, '\" (Bonus ', {complexity_bonus()}, ').')"),
    ("zahlwoerter", f"{_WORD} AND {_in('lower', L.NUMBER_WORDS)}", "", "concat('Zahlwort \"', text, '\" sollte als Ziffer geschrieben werden. Text-Position: ', t_start, '-', t_end)"),
    ("zahlwoerter", f"{_WORD} AND (rx(text, '{L.ROMAN}') OR rx(lower, '{L.NUMBERS_TO_100}'))", "", "concat('Zahl \"', text, '\" sollte als Ziffer geschrieben werden. Text-Position: ', t_start, '-', t_end)"),
    ("negationen", f"{_WORD} AND {_in('lower', L.NEG_PARTICLES)}", "", "concat('Negationspartikel \"', text, '\" macht den Satz schwer verständlich.')"),
    ("negationen", f"{_WORD} AND {_in('lower', L.NEG_DETERMINERS)}", "", "concat('Negative Bestimmung \"', text, '\" macht den Satz schwer verständlich.')"),
    ("negationen", f"{_WORD} AND {_in('lower', L.NEG_ADVERBS)}", "", "concat('Negative Aussage (Adverb) \"', text, '\" macht den Satz schwer verständlich.')"),
    ("negationen", f"{_WORD} AND {_in('lower', L.NEG_PRONOUNS)}", "", "concat('Negative Aussage (Pronomen) \"', text, '\" macht den Satz schwer verständlich.')"),
    ("negationen", f"{_WORD} AND length(lower) >= 5 AND NOT {_in('lower', L.NEG_STOPLIST)} AND (rx(lower, '^un') AND length(lower) > 4 OR rx(lower, '^miss') AND length(lower) > 6 OR rx(lower, 'los$') AND length(lower) > 5 OR rx(lower, 'frei$') AND length(lower) > 6)", "", "concat('Negationsform \"', text, '\" erschwert das Verständnis.')"),
    ("konjunktiv", f"{_WORD} AND {_in('lower', L.SUBJUNCTIVE_FORMS)}", "NOT (lower = 'sei' AND coalesce(prev1, '') = 'es' AND coalesce(next1, '') = 'denn')", "concat('Konjunktiv \"', text, '\".')"),
    ("genitiv", "lower = 'des'", "rx(coalesce(next1, ''), '^[a-zäöüß]{3,}[sn]$')", "concat('Genitiv \"', text, ' ', next1, '\".')"),
    ("genitiv", f"{_WORD} AND {_in('lower', L.GENITIVE_PREPOSITIONS)}", _in("coalesce(next1, '')", ("des", "der", "eines", "einer")), "concat('Genitiv \"', text, ' ', next1, '\".')"),
    ("passiv_erkennung", f"{_WORD} AND length(lower) >= 7 AND rx(text, '^[a-zäöüß]') AND rx(lower, '(bar|abel)$')", "", "concat('Passivähnliches Adjektiv \"', text, '\".')"),
    ("nebensaetze", "text = ','", _in("coalesce(next1, '')", L.SUBORDINATORS), "concat('Nebensatz mit \"', next1, '\".')"),
    ("nebensaetze", "text = ','", _in("coalesce(next1, '')", L.MORE_SUBORDINATORS), "concat('Nebensatz mit \"', next1, '\".')"),
    ("nebensaetze", "text = ','", _in("coalesce(next1, '')", L.SUBJECT_PRONOUNS), "concat('Zweiter Hauptsatz mit \"', next1, '\".')"),
    ("abkuerzungen", f"{_WORD} AND rx(text, '[a-zäöüß][A-ZÄÖÜ]')", "", "concat('Abkürzung erkannt: \"', text, '\" Schreiben Sie die Abkürzung aus.')"),
    ("abkuerzungen", f"{_WORD} AND {_in('text', L.SHORT_FORMS)}", "coalesce(next1, '') = '.'", "concat('Abkürzung erkannt: \"', text, '.\" Schreiben Sie die Abkürzung aus.')"),
    ("personalpronomen", f"{_WORD} AND lower = 'man'", "", "concat('Unpersönliches \"', text, '\".')"),
    ("personalpronomen", f"{_WORD} AND {_in('lower', L.THIRD_PERSON)}", f"NOT (i > 0 AND {_CAPITAL}) AND NOT (lower = 'sie' AND rx(coalesce(next1, ''), 'en$'))", "concat('Pronomen \"', text, '\" ohne klaren Bezug.')"),
    ("nebensaetze", "text = ','", _in("coalesce(next1, '')", L.INTERROGATIVES), "concat('Nebensatz mit \"', next1, '\".')"),
)

#: (rule, predicate over sentences, message); see ``sentence_features``.
_SCORE = "(5.0 * n_paren + 2.0 * n_passive + 1.5 * n_modal + 2.0 * n_nominal + 7.2 * n_sub)"
SENTENCE_RULES: tuple[tuple[str, str, str], ...] = (
    ("satzlaenge", f"n_words > (CASE WHEN {_SCORE} > 5 THEN 8 WHEN {_SCORE} > 3 THEN 9 ELSE 10 END) OR {_SCORE} > 6", f"concat('Satz ', sent_no, ' ist zu komplex (', n_words, ' Wörter, Typ: ', CASE WHEN {_SCORE} > 8 THEN 'hochkomplex' WHEN {_SCORE} > 5 THEN 'komplex' WHEN n_words > 15 THEN 'lang' WHEN n_words > 10 THEN 'mittel' ELSE 'einfach' END, ', Priorität: ', CASE WHEN {_SCORE} > 8 THEN 'sehr hoch' WHEN {_SCORE} > 5 OR n_words > 15 THEN 'hoch' WHEN n_words > 12 THEN 'mittel' ELSE 'niedrig' END, ').')"),
    ("kurze_woerter", "n_long >= 3", "concat('Satz ', sent_no, ' enthält ', n_long, ' lange Wörter.')"),
    ("kurze_woerter", "n_counted > 0 AND 1.0 * syll_counted / n_counted > 3.0", "concat('Satz ', sent_no, ' hat eine zu große durchschnittliche Wortlänge.')"),
    ("interpunktion", f"n_commas > {L.MAX_COMMAS}", f"concat('Satz ', sent_no, ' enthält ', n_commas, ' Kommas. Erlaubt sind {L.MAX_COMMAS}.')"),
    ("mehrere_aussagen", "n_words >= 4 AND (n_split > 10 AND (lower(text) LIKE '% und %' OR lower(text) LIKE '% aber %' OR lower(text) LIKE '% oder %' OR lower(text) LIKE '% doch %') OR n_commas >= 2)", "concat('Satz ', sent_no, ' enthält mehrere Aussagen.')"),
    ("passiv_erkennung", "n_passive > 0", "concat('Passiv in Satz ', sent_no, '.')"),
    ("perplexity_saetze", "length(text) >= 10 AND (n_sub > 0 OR n_passive > 0 OR n_words > 18 OR n_words >= 3 AND 100 * n_long >= 25 * n_words)", "concat('Satz ', sent_no, ' ist schwer zu lesen (', (CASE WHEN n_sub > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_passive > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_words > 18 OR n_words > 12 AND (n_sub > 0 OR n_passive > 0) THEN 1 ELSE 0 END), ' Gründe).')"),
    ("nebensaetze", "last_token = ','", "concat('Satz ', sent_no, ' endet mit einem Komma.')"),
    ("personalpronomen", "n_pronouns > 3", "concat('Satz ', sent_no, ' enthält ', n_pronouns, ' Pronomen.')"),
)

_SOME = "(?:[^ ]+ ){0,12}?"
_PARTICIPLE = "(?:[a-zäöüß]*ge[a-zäöüß]+(?:t|en)|(?:be|er|ver|zer|ent|emp)[a-zäöüß]{2,}t)"
_HARD_NEGATION = "concat('Komplexe Negation \"', m, '\" ist schwer verständlich.')"
#: (rule, a sentence's words between blanks ("joined") or its text, pattern, first words that it doesn't hold for, message for what is found: m)
PATTERN_RULES: tuple[tuple[str, str, str, tuple[str, ...], str], ...] = (
    ("negationen", "joined", " ohne ", (), "concat('Präpositionale Negation \"', m, '\" ist schwer verständlich.')"),
    ("negationen", "joined", " kaum ", (), "concat('Limitierendes Adverb \"', m, '\" ist schwer verständlich.')"),
    ("negationen", "joined", " weder (?:[^ .,;:!?]+ ){0,5}?noch ", (), "concat('Mehrteilige Negation \"', m, '\" ist schwer verständlich.')"),
    ("negationen", "joined", " (?:noch|gar|überhaupt) (?:nicht|nichts|nie) ", (), _HARD_NEGATION),
    ("negationen", "joined", " (?:nicht|nie) (?:mehr|wieder|länger|einmal) ", (), _HARD_NEGATION),
    ("negationen", "joined", " auf kein(?:en|e|em)? (?:fall|fälle|fällen) ", (), _HARD_NEGATION),
    ("negationen", "joined", " unter kein(?:en|e|em)? (?:umstand|umstände|umständen) ", (), _HARD_NEGATION),
    *(("redewendungen", "lowered", unicode_pattern(p), (), "concat('Bildhafter Ausdruck \"', m, '\".')") for p in L.METAPHORS),
    ("passiv_erkennung", "joined", f" (?:bin|bist|ist|sind|seid|war|warst|waren|wart) {_SOME}{_PARTICIPLE} worden ", (), "concat('Passiv \"', m, '\".')"),
    ("passiv_erkennung", "joined", f" {_alt(L.MODAL_FORMS).replace('(', '(?:', 1)} {_SOME}{_PARTICIPLE} werden ", (), "concat('Passiv mit Modalverb \"', m, '\".')"),
    ("passiv_erkennung", "joined", f" (?:bin|bist|ist|sind|seid|war|waren) {_SOME}zu [a-zäöüß]+(?:en|ern|eln) ", (), "concat('Passiversatz \"', m, '\".')"),
    ("passiv_erkennung", "joined", f" (?:bin|bist|ist|sind|seid|war|waren) {_SOME}(?:[a-zäöüß]{{2,4}})?ge[a-zäöüß]+t [.!?] ", (), "concat('Zustandspassiv \"', m, '\".')"),
    ("passiv_erkennung", "joined", f" (?:lässt|lassen|lasse|ließ|ließen) sich | sich {_SOME}(?:lässt|lassen|lasse|ließ|ließen) ", (), "concat('Passiversatz \"', m, '\".')"),
    ("nebensaetze", "text", f", {_alt(L.RELATIVE_PRONOUNS).replace('(', '(?:', 1)} (?:[A-ZÄÖÜ][a-zäöüß]+ )?[a-zäöüß]+", (), "concat('Relativsatz \"', m, '\".')"),
    ("mehrere_aussagen", "joined", " , (?:aber|doch|jedoch|sondern|denn|der|die|das|er|sie|es|wir|ich) (?:[^ .,;:!?]+ ){2,}", (), "concat('Zweite Aussage \"', m, '\".')"),
    ("mehrere_aussagen", "joined", " und (?:[a-zäöüß]+t (?:[^ .,;:!?]+ )+|(?:der|die|das|er|sie|es|wir|ich|ein|eine) [^ .,;:!?]+ [a-zäöüß]+t )", (), "concat('Zweite Aussage \"', m, '\".')"),
    ("nebensaetze", "joined", f" um {_SOME}zu [a-zäöüß]+(?:en|ern|eln) ", (), "concat('Infinitivsatz \"', m, '\".')"),
    ("genitiv", "text", "[A-ZÄÖÜ][a-zäöüß]+ (?:der|einer|dieser|jeder|unserer|ihrer|seiner|meiner) [A-ZÄÖÜ][a-zäöüß]+", (), "concat('Genitiv \"', m, '\".')"),
    ("genitiv", "text", "[A-ZÄÖÜ][a-zäöü]+s [A-ZÄÖÜ][a-zäöüß]+", ("das", "des", "dies", "alles", "eines", "dieses", "jedes", "es", "was", "als", "bis", "aus", "ins"), "concat('Sächsischer Genitiv \"', m, '\".')"),
)

#: (name, pattern in the whole text, term if not what is found, message for a term)
MARKS: tuple[tuple[str, str, str | None, str], ...] = (
    ("repeated", "[.!?]{2,}", None, "concat('Mehrfache Satzzeichen \"', term, '\" sind verwirrend.')"),
    ("ellipsis", "[.][.][.]|…", "...", "'Auslassungspunkte \"...\" oder \"…\" gefunden.'"),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", None, "concat('E-Mail-Adresse \"', term, '\" im Fließtext gefunden.')"),
    ("url", "(?:https?://|www[.])[^ \t\n\r<>]+", None, "concat('URL \"', term, '\" im Fließtext gefunden.')"),
)

#: Counted tokens of a sentence: name -> predicate over tokens.
FEATURES = {
    "n_words": "kind <> 'p'",
    "n_commas": "text = ','",
    "n_sub": f"{_WORD} AND {_in('lower', L.SUBORDINATORS)}",
    "n_modal": f"{_WORD} AND {_in('lower', L.MODAL_FORMS)}",
    "n_nominal": f"{_WORD} AND {_CAPITAL} AND rx(lower, '{_alt(L.NOMINAL_SUFFIXES)}$')",
    "n_werden": f"{_WORD} AND {_in('lower', L.WERDEN_FORMS)}",
    "n_participles": f"{_WORD} AND (rx(lower, '^([a-zäöü]{{2,4}})?ge[a-zäöüß]+(t|en)$') OR rx(lower, '^(be|er|ver|zer|ent|emp)[a-zäöüß]{{2,}}t$')) AND rx(text, '^[a-zäöüß]')",
    "n_counted": COUNTED,
    "n_long": f"{COUNTED} AND n_syll > {L.MAX_SYLLABLES}",
    "n_pronouns": f"{_WORD} AND {_in('lower', L.PERSONAL_PRONOUNS)}",
}
_PAREN = (r"\([^)]+\)", r"\[[^\]]+\]", "—[^—]+—", ",[^,]{3,},")


_LONG_FLAG = f"{_WORD} AND length(text) >= 4 AND n_syll > {L.MAX_SYLLABLES}"
_OF_SENTENCE = {"counts": tuple(FEATURES.items()), "syllables": COUNTED, "long": _LONG_FLAG, "parens": _PAREN, "sentences": True}


def _passive() -> Column:
    return F.when((F.col("n_werden") > 0) & (F.col("n_participles") > 0), 1).otherwise(0).alias("n_passive")


def sentence_features(a: Annotated) -> DataFrame:
    """Sentences with counts of what stands in them."""
    s = findings(a.docs, Wanted(**_OF_SENTENCE, joined=""))
    return s.select("doc_id", "sent_no", F.col("t_start").alias("start_char"), F.col("t_end").alias("end_char"), "text", *FEATURES, "syll_counted", _passive(), "n_paren", "n_split", "last_token", "joined", "long_flags")


FEATURES_SQL = (
    TOKENS_SQL
    + """, sf AS (
  SELECT sent.doc_id, sent.sent_no, sent.start_char, sent.end_char, any_value(sent.text) AS text, """
    + ", ".join(f"CAST(count(*) FILTER (WHERE {duck_sql(re.sub(r'(?<![.])(?<!\w)text\b', 'tok.text', p))}) AS INTEGER) AS {n}" for n, p in FEATURES.items())
    + f""",
    CAST(coalesce(sum(n_syll) FILTER (WHERE {re.sub(r'(?<![.])(?<!\w)text', 'tok.text', COUNTED)}), 0) AS INTEGER) AS syll_counted,
    CASE WHEN n_werden > 0 AND n_participles > 0 THEN 1 ELSE 0 END AS n_passive,
    CAST("""
    + " + ".join(f"len(regexp_extract_all(any_value(sent.text), '{p}'))" for p in _PAREN)
    + r""" AS INTEGER) AS n_paren,
    CAST(len(list_filter(regexp_split_to_array(any_value(sent.text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS INTEGER) AS n_split,
    arg_max(tok.text, tok.i) AS last_token, string_agg(tok.lower, ' ' ORDER BY tok.i) AS joined,
    string_agg(CASE WHEN kind = 'w' AND length(tok.text) >= 4 AND n_syll > 3 THEN '1' ELSE '0' END, '' ORDER BY tok.i) AS long_flags
  FROM sent JOIN tok ON tok.doc_id = sent.doc_id AND tok.sent_no = sent.sent_no GROUP BY ALL
)"""
)


_TRIM_SQL = r"regexp_replace(text, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def token_rule_sql(rule: str, predicate: str, context: str, message: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule, sent_no, t_start, t_end, text AS term, {duck_sql(message)} AS message FROM tok WHERE ({duck_sql(predicate)}) AND {duck_sql(context or 'true')}"


def sentence_rule_sql(rule: str, predicate: str, message: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule, sent_no, start_char AS t_start, end_char AS t_end, {_TRIM_SQL} AS term, {duck_sql(message)} AS message FROM sf WHERE {duck_sql(predicate)}"


def pattern_rule_sql(rule: str, column: str, pattern: str, but: tuple[str, ...], message: str) -> str:
    where = f" WHERE NOT {_in("lower(split_part(m, ' ', 1))", but)}" if but else ""
    source = {"joined": "' ' || joined || ' '", "text": "text", "lowered": "lower(text)"}[column]
    group = 1 if column == "lowered" else 0
    return f"SELECT doc_id, '{rule}' AS rule, sent_no, start_char AS t_start, end_char AS t_end, m AS term, {message} AS message FROM (SELECT * REPLACE (trim(m) AS m) FROM (SELECT *, unnest(regexp_extract_all({source}, '{pattern}', {group})) AS m FROM sf)){where}"


def marks_sql() -> str:
    each = [f"SELECT DISTINCT doc_id, {f"'{fixed}'" if fixed else 'm'} AS term, '{name}' AS mark FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM documents)" for name, pattern, fixed, _ in MARKS]
    said = " ".join(f"WHEN mark = '{name}' THEN {message}" for name, _, _, message in MARKS)
    return f"SELECT doc_id, 'interpunktion' AS rule, CAST(NULL AS INTEGER) AS sent_no, CAST(NULL AS INTEGER) AS t_start, CAST(NULL AS INTEGER) AS t_end, term, CASE {said} END AS message FROM ({' UNION ALL '.join(each)}) WHERE NOT (mark = 'repeated' AND term = '...')"


# --- rules over whole documents


WORD_RUNS_SQL = "SELECT doc_id, 'kurze_woerter' AS rule, sent_no, start_char AS t_start, end_char AS t_end, '' AS term, concat('Sequenz von ', length(run), ' langen Wörtern hintereinander.') AS message FROM (SELECT *, unnest(regexp_extract_all(long_flags, '1{2,}')) AS run FROM sf)"


FORBIDDEN_SQL = (
    "SELECT doc_id, 'interpunktion' AS rule, arg_min(sent_no, t_start) AS sent_no, min(t_start) AS t_start, arg_min(t_end, t_start) AS t_end, text AS term, concat('Zeichen \"', text, '\" gefunden (', count(*), ' Mal).') AS message "
    + "FROM tok WHERE kind = 'p' AND text NOT IN ("
    + ", ".join(f"chr({ord(c)})" for c in dict.fromkeys(L.ALLOWED_MARKS + L.ALLOWED_QUOTES + L.TECHNICAL + ","))
    + r") AND NOT regexp_matches(text, '^[\p{N}\p{M}]') GROUP BY doc_id, text"
)


FOREIGN_SQL = f"""SELECT doc_id, 'fremdwoerter' AS rule, sent_no, t_start, t_end, text AS term, message FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower ORDER BY t_start) AS r FROM (
    SELECT tok.doc_id, tok.lower, tok.sent_no, tok.t_start, tok.t_end, tok.text, lx.d + CASE WHEN sf.n_words > 15 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(string_split(sf.joined, ' '), lambda w: {_in('w', [x[0] for x in L.FOREIGN_WORDS])})) / len(string_split(sf.joined, ' ')) > 0.2 THEN 3 ELSE 0 END AS score, 7 AS least,
      concat('Fremdwort "', tok.text, '" (Kategorie: ', lx.c, ', Priorität: ', CASE WHEN score >= 9 THEN 'hoch' ELSE 'mittel' END, '). Einfacher: "', lx.p, '".') AS message
    FROM tok JOIN (VALUES {', '.join(f"('{w}', '{p}', {round(d * 10)}, '{c}')" for w, p, d, c in L.FOREIGN_WORDS)}) lx(w, p, d, c) ON lx.w = tok.lower JOIN sf ON sf.doc_id = tok.doc_id AND sf.sent_no = tok.sent_no
    WHERE NOT {_in('tok.lower', (*L.COMMON_WORDS, *L.ACRONYMS))}
    UNION ALL
    SELECT doc_id, lower, sent_no, t_start, t_end, text, {duck_sql(foreign_score())} AS score, 8 AS least, concat('Mögliches Fremdwort "', text, '" (Score ', {duck_sql(foreign_score())}, ').') AS message
    FROM tok WHERE kind = 'w' AND length(lower) >= 4 AND NOT {_in('lower', (*L.COMMON_WORDS, *L.ACRONYMS))} AND NOT {_in('lower', [x[0] for x in L.FOREIGN_WORDS])} AND {duck_sql(foreign_score())} >= 8)
) WHERE r = 1 AND score >= least"""


#: (phrase, meaning, tenths of difficulty, category or none for what is figurative only)
PHRASES = (*((p, m, round(d * 10), c) for p, m, d, c in L.IDIOMS), *((p, m, round(d * 10), "") for p, m, d in L.FIGURATIVE if d >= 0.6))


def _idioms_sql() -> str:
    idioms, figurative = [x for x in PHRASES if x[3]], [x for x in PHRASES if not x[3]]
    found = lambda own, ratio: windows_sql([p.split() for p, *_ in own], ratio, L.PLACEHOLDERS)
    values = lambda own: ", ".join(f"({k}, '{p}', '{m}', {d}, '{c}')" for k, (p, m, d, c) in enumerate(own))
    first = "SELECT doc_id, 'redewendungen' AS rule, arg_min(sent_no, t_start) AS sent_no, min(t_start) AS t_start, arg_min(t_end, t_start) AS t_end, p AS term,"
    score = f"d + CASE WHEN n_words > 15 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{'|'.join(L.IDIOM_CONTEXT)}') THEN 3 ELSE 0 END + CASE WHEN len(list_filter(string_split(joined, ' '), lambda w: regexp_matches(w, '{'|'.join(L.ANIMALS)}'))) > 1 THEN 4 ELSE 0 END"
    return f"""{first} concat('Redewendung "', p, '" (Kategorie: ', any_value(c), ', Priorität: ', arg_min(CASE WHEN s >= 10 THEN 'hoch' ELSE 'mittel' END, t_start), '). Wörtlich: "', any_value(m), '".') AS message FROM (
    SELECT f.*, x.*, {score} AS s, text FROM ({found(idioms, 0.8)}) f JOIN (VALUES {values(idioms)}) x(k, p, m, d, c) ON f.phrase = x.k JOIN sf ON sf.doc_id = f.doc_id AND sf.sent_no = f.sent_no)
  WHERE s >= 8 AND NOT regexp_matches(lower(text), '{"|".join(L.LITERAL_MARKERS)}') GROUP BY doc_id, p
  UNION ALL {first} concat('Bildhafter Ausdruck "', p, '". Wörtlich: "', any_value(m), '".') AS message FROM ({found(figurative, 1.0)}) f JOIN (VALUES {values(figurative)}) x(k, p, m, d, c) ON f.phrase = x.k GROUP BY doc_id, p"""


IDIOMS_SQL = _idioms_sql()


ABBREVIATIONS_SQL = f"""SELECT doc_id, 'abkuerzungen' AS rule, sent_no, t_start, t_end, text AS term, concat('Abkürzung erkannt: "', text, '." Schreiben Sie die Abkürzung aus.') AS message
  FROM tok WHERE kind = 'w' AND {_in('text', L.TITLE_ABBREVIATIONS)} AND next1 = '.' AND NOT EXISTS (
    SELECT 1 FROM (SELECT doc_id AS d_id, unnest(regexp_extract_all(text, '\\(([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß0-9-]{{1,8}})\\)', 1)) AS abbr FROM documents) WHERE d_id = tok.doc_id AND lower(abbr) = tok.lower)"""


SYNONYMS_SQL = f"""SELECT x.doc_id, 'synonyme' AS rule, x.sent_no, x.t_start, x.t_end, word AS term, concat('Synonyme "', word, '" und "', other, '". Besser: "', plain, '".') AS message
  FROM (VALUES {', '.join(f"('{w}', '{r}', '{s}')" for w, r, ss in L.SYNONYMS for s in ss)}) p(word, plain, other)
  JOIN (SELECT doc_id, lower, min(t_start) AS t_start, arg_min(t_end, t_start) AS t_end, arg_min(sent_no, t_start) AS sent_no FROM tok WHERE kind = 'w' GROUP BY doc_id, lower) x ON x.lower = word
  JOIN (SELECT DISTINCT doc_id, lower FROM tok WHERE kind = 'w') y ON y.lower = other AND y.doc_id = x.doc_id"""


MEAN_SQL = "SELECT doc_id, 'satzlaenge' AS rule, CAST(NULL AS INTEGER) AS sent_no, CAST(NULL AS INTEGER) AS t_start, CAST(NULL AS INTEGER) AS t_end, '' AS term, concat('Durchschnittliche Satzlänge ist zu hoch: ', sum(n_words), ' Wörter in ', count(*), ' Sätzen.') AS message FROM sf GROUP BY doc_id HAVING sum(n_words) > 10 * count(*)"

BODY_SQL = f"""SELECT doc_id, 'redewendungen' AS rule, sent_no, start_char AS t_start, end_char AS t_end, part || ' ' || verb AS term, concat('Körperteil-Metapher "', part, ' ', verb, '".') AS message
  FROM sf JOIN (VALUES {', '.join(f"('{part}', '{verb}')" for part, verbs in L.BODY_PART_VERBS for verb in verbs)}) b(part, verb) ON contains(lower(text), part) AND contains(lower(text), verb)
  WHERE NOT regexp_matches(lower(text), '{"|".join(L.ILL)}')"""

_OWN_SQL: dict[str, tuple[str, ...]] = {
    "kurze_woerter": (WORD_RUNS_SQL,),
    "interpunktion": (FORBIDDEN_SQL, marks_sql()),
    "fremdwoerter": (FOREIGN_SQL,),
    "redewendungen": (IDIOMS_SQL, BODY_SQL),
    "abkuerzungen": (ABBREVIATIONS_SQL,),
    "synonyme": (SYNONYMS_SQL,),
    "satzlaenge": (MEAN_SQL,),
}
RULES = tuple(sorted(TIERS))

_LEXICON = [w for w, *_ in L.FOREIGN_WORDS]
_ORDINARY = f"{_WORD} AND NOT {_in('lower', (*L.COMMON_WORDS, *L.ACRONYMS))}"
#: Words that rules over whole documents look for: rule -> flag -> predicate.
_DOCUMENT_WORDS = {
    "interpunktion": {"char": f"kind = 'p' AND NOT {_in('text', dict.fromkeys(L.ALLOWED_MARKS + L.ALLOWED_QUOTES + L.TECHNICAL + ','))} AND NOT rx(text, '^[\\p{{N}}\\p{{M}}]')"},
    "fremdwoerter": {"known": f"{_ORDINARY} AND {_in('lower', _LEXICON)}", "guessed": f"{_ORDINARY} AND length(lower) >= 4 AND NOT {_in('lower', _LEXICON)} AND {foreign_score()} >= 8"},
    "abkuerzungen": {"short": f"{_WORD} AND {_in('text', L.TITLE_ABBREVIATIONS)}"},
}
_EXPLAINED = r"\(([A-ZÄÖÜ][A-ZÄÖÜa-zäöüß0-9-]{1,8})\)"


def wanted(rules: tuple[str, ...], texts: bool = False, keep: tuple[str, ...] = ()) -> Wanted:
    """What the scan is to find for these rules."""
    words = {f"t{k}": predicate for k, (rule, predicate, _, _) in enumerate(TOKEN_RULES) if rule in rules}
    for rule, own in _DOCUMENT_WORDS.items():
        words |= own if rule in rules else {}
    patterns = {column: "|".join(f"(?:{p})" for rule, c, p, _, _ in PATTERN_RULES if rule in rules and c == column) for column in ("joined", "text", "lowered")}
    idioms = "redewendungen" in rules
    if idioms:
        patterns["text"] = "|".join(filter(None, (patterns["text"], f"(?i:{'|'.join(part for part, _ in L.BODY_PART_VERBS)})", f"(?i:{'|'.join(loose_pattern(p) for p in L.METAPHORS)})")))
    sentences = any(r in rules for r, *_ in SENTENCE_RULES) or any(patterns.values())
    counts = tuple(FEATURES.items()) if sentences else (("n_words", FEATURES["n_words"]),)
    return Wanted(
        texts=texts,
        keep=keep,
        **(_OF_SENTENCE if sentences else {"counts": counts}),
        words=tuple(words.items()),
        tokens=tuple(words),
        once=tuple(g for g in (("char",), ("known", "guessed")) if g[0] in words),
        joined=patterns["joined"] or None,
        cased=patterns["text"] or None,
        means="satzlaenge" in rules,
        undefined="short" if "short" in words else "",
        explained=_EXPLAINED,
        foreign=_in("lower", _LEXICON) if "known" in words else "",
        phrases=PHRASES if idioms else (),
        harder=L.IDIOM_CONTEXT,
        animals=L.ANIMALS,
        literal=L.LITERAL_MARKERS,
        placeholders=L.PLACEHOLDERS,
        pairs=tuple(L.SYNONYMS) if "synonyme" in rules else (),
        marks=tuple((name, p, fixed) for name, p, fixed, _ in MARKS) if "interpunktion" in rules else (),
    )


def _said(rule: str, message: Column, term: Column | None = None, place: bool = True) -> Column:
    none = F.lit(None).cast("int")
    where = [F.col(c).alias(c) if place else none.alias(c) for c in ("sent_no", "t_start", "t_end")]
    return F.struct(F.lit(rule).alias("rule"), *where, (F.col("text") if term is None else term).alias("term"), message.alias("message"))


def _of_tokens(want: Wanted, rules: tuple[str, ...], tell: Callable[..., Column]) -> list[Column]:
    has = lambda column, flag: F.col(column).bitwiseAND(F.lit(want.bit(flag))) != 0
    out = []
    for k, (rule, _, context, message) in enumerate(TOKEN_RULES):
        if rule in rules:
            found = has("flags", f"t{k}")
            out.append(F.when(found & F.expr(spark_sql(context)) if context else found, tell(rule, F.expr(spark_sql(message)))))
    if "interpunktion" in rules:
        out.append(F.when(has("first", "char"), tell("interpunktion", F.concat(F.lit('Zeichen "'), "text", F.lit('" gefunden ('), "n", F.lit(" Mal).")))))
    if "fremdwoerter" in rules:
        lexicon = F.create_map(*(x for w, p, d, c in L.FOREIGN_WORDS for x in (F.lit(w), F.struct(F.lit(p).alias("plain"), F.lit(round(d * 10)).alias("difficulty"), F.lit(c).alias("category")))))
        entry = F.try_element_at(lexicon, F.col("lower"))
        score = entry["difficulty"] + F.when(F.col("s_words") > 15, 2).otherwise(0) + F.when(F.col("s_foreign") / F.col("s_tokens") > 0.2, 3).otherwise(0)
        known = F.concat(F.lit('Fremdwort "'), "text", F.lit('" (Kategorie: '), entry["category"], F.lit(", Priorität: "), F.when(score >= 9, "hoch").otherwise("mittel"), F.lit('). Einfacher: "'), entry["plain"], F.lit('".'))
        guessed = F.concat(F.lit('Mögliches Fremdwort "'), "text", F.lit('" (Score '), F.expr(spark_sql(foreign_score())), F.lit(")."))
        first = has("first", "known")
        out += [F.when(first & has("flags", "known") & (score >= 7), tell("fremdwoerter", known)), F.when(first & has("flags", "guessed"), tell("fremdwoerter", guessed))]
    if "abkuerzungen" in rules:
        out.append(F.when(has("flags", "short") & (F.col("next1") == "."), tell("abkuerzungen", F.concat(F.lit('Abkürzung erkannt: "'), "text", F.lit('." Schreiben Sie die Abkürzung aus.')))))
    return out


def _of_sentences(rules: tuple[str, ...], tell: Callable[..., Column]) -> tuple[list[Column], list[tuple[str, Column, Callable[[Column], Column]]]]:
    """What is found once in a sentence; and what may be several times: rule, array, what is told of an element."""
    term = T.strip(F.col("text"))
    quoting = lambda rule, before, after: lambda m: tell(rule, F.concat(F.lit(before), F.trim(m), F.lit(after)), F.trim(m))
    once = [F.when(F.expr(spark_sql(p).replace("lower(text)", "low")), tell(r, F.expr(spark_sql(m)), term)) for r, p, m in SENTENCE_RULES if r in rules]
    out: list[tuple[str, Column, Callable[[Column], Column]]] = []
    for rule, column, pattern, but, message in PATTERN_RULES:
        if rule in rules:
            source = {"joined": F.concat(F.lit(" "), F.col("joined"), F.lit(" ")), "text": F.col("lower"), "lowered": F.col("low_cased")}[column]
            found = F.regexp_extract_all(source, F.lit(spark_pattern(pattern)), F.lit(1 if column == "lowered" else 0))
            if but:
                found = F.filter(found, lambda m: ~F.lower(F.split_part(F.trim(m), F.lit(" "), F.lit(1))).isin(*but))  # noqa: B023  called at once
            before, after = re.fullmatch(r"concat\('(.*)', m, '(.*)'\)", message).groups()
            out.append((rule, found, quoting(rule, before, after)))
    if "kurze_woerter" in rules:
        out.append(("kurze_woerter", F.regexp_extract_all("long_flags", F.lit("1{2,}"), F.lit(0)), lambda x: tell("kurze_woerter", F.concat(F.lit("Sequenz von "), F.length(x), F.lit(" langen Wörtern hintereinander.")), F.lit(""))))
    if "redewendungen" in rules:
        pairs = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(verb).alias("verb")) for part, verbs in L.BODY_PART_VERBS for verb in verbs))
        text = F.col("low_cased")  # given only where a part of the body is named
        named = F.filter(pairs, lambda x: F.contains(text, x["part"]) & F.contains(text, x["verb"]))
        well = F.when(~text.rlike("|".join(L.ILL)), named)
        out.append(("redewendungen", well, lambda x: tell("redewendungen", F.concat(F.lit('Körperteil-Metapher "'), x["part"], F.lit(" "), x["verb"], F.lit('".')), F.concat(x["part"], F.lit(" "), x["verb"]))))
    return once, out


_SAID = "array<struct<rule:string,sent_no:int,t_start:int,t_end:int,term:string,message:string>>"


def _of_others(want: Wanted, tell: Callable[..., Column]) -> list[tuple[str, Column, Column]]:
    """(what, condition, what is told) of findings that stand for one violation each."""
    true = F.lit(True)
    found = []
    if want.phrases:
        said = F.when(F.col("next1") == "", F.concat(F.lit('Bildhafter Ausdruck "'), "text", F.lit('"'))).otherwise(F.concat(F.lit('Redewendung "'), "text", F.lit('" (Kategorie: '), "next1", F.lit(", Priorität: "), F.when(F.col("n") >= 10, "hoch").otherwise("mittel"), F.lit(")")))
        found.append(("i", true, tell("redewendungen", F.concat(said, F.lit('. Wörtlich: "'), "lower", F.lit('".')))))
    if want.pairs:
        found.append(("y", true, tell("synonyme", F.concat(F.lit('Synonyme "'), "text", F.lit('" und "'), "lower", F.lit('". Besser: "'), "next1", F.lit('".')))))
    if want.marks:
        said = F.expr("CASE " + " ".join(f"WHEN lower = '{name}' THEN {re.sub(r'\bterm\b', 'text', message)}" for name, _, _, message in MARKS) + " END")
        found.append(("m", ~((F.col("lower") == "repeated") & (F.col("text") == "...")), tell("interpunktion", said, place=False)))
    if want.means:
        said = F.concat(F.lit("Durchschnittliche Satzlänge ist zu hoch: "), "s_words", F.lit(" Wörter in "), "n", F.lit(" Sätzen."))
        found.append(("d", F.col("s_words") > 10 * F.col("n"), tell("satzlaenge", said, F.lit(""), place=False)))
    return found


def _scan(docs: DataFrame, want: Wanted) -> DataFrame:
    f = findings(docs, want)
    if not want.sentences:
        return f
    # lower case is slow to make: once for a sentence, and only where it is asked for
    return f.withColumns({"n_passive": _passive(), "low": F.when((F.col("what") == "s") & (F.col("n_split") > 10), F.lower("text")), "low_cased": F.when(F.col("what") == "s", F.lower("lower"))})


def found_in(docs: DataFrame, rules: tuple[str, ...] = RULES, texts: bool = False) -> DataFrame:
    """row, batch (see ``findings``) and the columns of violations. With ``texts``, each document has a row without a rule as well, first in its batch: its text as term, ``about`` as message."""
    want = wanted(rules, texts)
    is_a = lambda what: F.col("what") == what
    none = F.array().cast(_SAID)
    found = []
    if tokens := _of_tokens(want, rules, _said):
        found.append(F.when(is_a("t"), F.array_compact(F.array(*tokens)).cast(_SAID)))
    once, several = _of_sentences(rules, _said)
    sentences = [F.array_compact(F.array(*once))] if once else []
    if sentences := [*sentences, *(F.transform(x, each) for _, x, each in several)]:
        found.append(F.when(is_a("s"), F.concat(*(F.coalesce(x.cast(_SAID), none) for x in sentences))))
    found += [F.when(is_a(what) & condition, F.array(said).cast(_SAID)) for what, condition, said in _of_others(want, _said)]
    if want.texts:
        found.append(F.when(is_a("x"), F.array(_said("", F.col("lower"), F.col("text"), place=False)).cast(_SAID)))
    return _scan(docs, want).select("row", "batch", "doc_id", F.inline(F.coalesce(*found, none)))


def priced(docs: DataFrame, price: Callable[[str], int], keep: tuple[str, ...]) -> DataFrame:
    """row, batch, cost of what is found there by each rule's ``price``, without messages; each document has a row with its text and the columns ``keep`` (whole numbers) as well, first in its batch."""
    own = tuple(f"kept_{c}" for c in keep)  # findings have columns of other names
    want = wanted(RULES, True, own)
    docs = docs.select(F.lit(0).alias("doc_id"), "text", *(F.col(c).cast("long").alias(k) for c, k in zip(keep, own, strict=True)))
    none = F.lit(0).cast("long")
    tell = lambda rule, *_, **__: F.lit(price(rule)).cast("long")
    total = lambda costs: reduce(operator.add, costs, none)
    once, several = _of_sentences(RULES, tell)
    of = {"t": total(F.coalesce(x, none) for x in _of_tokens(want, RULES, tell)), "s": total([*(F.coalesce(x, none) for x in once), *(F.greatest(F.size(x), F.lit(0)) * price(rule) for rule, x, _ in several)])}
    of |= {what: F.when(condition, cost).otherwise(none) for what, condition, cost in _of_others(want, tell)}
    cost = F.coalesce(*(F.when(F.col("what") == what, x) for what, x in of.items()), none)
    is_text = F.col("what") == "x"
    # a filter by cost would compute it twice
    each = _scan(docs, want).where("what <> 'd' OR s_words > 10 * n").select("row", "batch", is_text.alias("is_text"), F.when(is_text, F.col("text")).alias("text"), *(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), cost.alias("cost"))
    return each


def violations(a: Annotated, rules: tuple[str, ...] = RULES) -> DataFrame:
    """All violations of these rules, in one scan and without a shuffle."""
    return found_in(a.docs, rules).select(*COLUMNS)


def check_rule(a: Annotated, rule: str) -> DataFrame:
    """All violations of one rule."""
    return violations(a, (rule,))


def forbidden_characters(a: Annotated) -> DataFrame:
    """Each character that isn't allowed, once for each document, with its count: doc_id, term, n."""
    f = findings(a.docs, Wanted(words=tuple(_DOCUMENT_WORDS["interpunktion"].items()), tokens=("char",), once=(("char",),)))
    return f.where("first <> 0").select("doc_id", F.col("text").alias("term"), "n")


def _parts(rule: str) -> list[str]:
    return [
        *(token_rule_sql(*x) for x in TOKEN_RULES if x[0] == rule),
        *(sentence_rule_sql(*x) for x in SENTENCE_RULES if x[0] == rule),
        *(pattern_rule_sql(*x) for x in PATTERN_RULES if x[0] == rule),
        *_OWN_SQL.get(rule, ()),
    ]


def rule_sql(rule: str) -> str:
    return f"WITH {FEATURES_SQL} " + " UNION ALL ".join(_parts(rule))


def violations_sql() -> str:
    """Shared common table expressions and v, the union of all rules."""
    return f"WITH {FEATURES_SQL}, v AS ({' UNION ALL '.join(x for rule in RULES for x in _parts(rule))}) "
