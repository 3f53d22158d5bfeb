"""Word classes, cases, moods and lemmas of German words: candidates by suffix, the best sequence by Viterbi.

Candidates of a word come from a list of closed classes, else from the longest suffix in a
trie that fits it, upper and lower case apart; each has a cost. Costs of neighbouring tags
are negative logarithms of counted pairs: of a few tagged sentences to begin with
(``TAGGED``), and then, by ``counted``, of the best tags of a corpus, which Spark counts.
A batch's sentences are decoded together, a place at a time.

Tags: D article (nom, gen, dat, acc), N noun (nom: not genitive; gen), E name, S name with -s, A adjective, P preposition
(P.gen governs the genitive), R1 R3 R pronouns, V X verb and auxiliary (ind, 1: first person in -e, k1, k2: subjunctive I and II), inf, part, adv, C
and K conjunctions (K subordinates), W relative or question word, Z particle, M number, Q sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import Scanned, batched

TAGS = ("D.nom", "D.gen", "D.dat", "D.acc", "N.nom", "N.gen", "E", "S", "A", "P", "P.gen", "R1", "R3", "R", "V.1", "V.ind", "V.k1", "V.k2", "X.ind", "X.k1", "X.k2", "inf", "part", "adv", "C", "K", "W", "Z", "M", "Q")
_T = {t: k for k, t in enumerate(TAGS)}
MOST = 4  #: candidates of a word

# --- closed classes: tag -> words; fixed values
CLOSED = {
    "D.nom": "der die das ein eine kein keine dieser diese dieses mein meine sein seine ihr ihre unser unsere jeder jede jedes",
    "D.gen": "des der eines einer dieses dieser jenes jener jedes jeder meines meiner seines seiner ihres ihrer unseres unserer keines keiner",
    "D.dat": "dem der den einem einer diesem dieser meinem meiner seinem seiner ihrem ihrer unserem unserer keinem keiner",
    "D.acc": "den die das einen eine ein diesen diese dieses meinen meine seinen seine ihren ihre unseren unsere keinen keine",
    "P": "in im am an auf aus bei beim mit nach von vom zu zum zur für durch gegen ohne um über unter vor hinter neben zwischen seit bis ins ans",
    "P.gen": "wegen trotz während innerhalb außerhalb anstatt statt aufgrund hinsichtlich angesichts mithilfe infolge zwecks bezüglich oberhalb unterhalb jenseits diesseits anhand mittels",
    "R1": "ich",
    "R3": "er sie es man jemand niemand wer",
    "R": "du wir ihr mich mir dich dir uns euch ihn ihm ihnen sich das dies alles nichts etwas",
    "X.ind": "bin bist ist sind seid war warst waren wart habe hast hat haben habt hatte hattest hatten hattet werde wirst wird werden werdet wurde wurden kann kannst können könnt konnte konnten muss musst müssen müsst musste mussten darf dürfen durfte durften soll sollst sollen sollte sollten will willst wollen wollte wollten mag mögen mochte",
    "X.k1": "sei seist seien seiet habe habest werde werdest könne könnest müsse müssest dürfe solle sollest wolle möge",
    "X.k2": "wäre wärst wären wärt hätte hättest hätten hättet würde würdest würden würdet könnte könntest könnten könntet müsste müsstest müssten dürfte dürften möchte möchtest möchten möchtet waere waeren haette haetten wuerde wuerden koennte koennten muesste muessten duerfte moechte",
    "V.k2": "käme kämen gäbe gäben ginge gingen bliebe blieben fände fänden spräche sprächen stürbe hülfe ließe ließen nähme nähmen sähe sähen stünde stünden bräuchte bräuchten wüsste wüssten täte täten läge lägen trüge schlüge fiele fielen riefe hielte hielten liefe schriebe böte flöge zöge kaeme gaebe faende naehme",
    "adv": "nicht sehr auch nur schon noch hier dort dann heute gestern morgen immer nie oft jetzt so wieder mehr vielleicht gern",
    "C": "und oder aber denn sondern doch",
    "K": "dass ob weil wenn falls sofern als bevor nachdem obwohl damit während sobald solange indem sodass da",
    "W": "der die das dem den dessen deren welche welcher welches was wo wie warum",
    "Z": "zu nicht",
}
#: Costs besides that of a word's first class.
_ASIDE = {"W": 1.5, "D.gen": 0.3, "D.acc": 0.1, "R": 0.4, "X.k1": 0.4, "P.gen": 0.2, "Z": 0.5, "K": 0.2, "V.k2": 0.0}
LEMMAS = {
    "sein": "bin bist ist sind seid war warst waren wart sei seist seien seiet wäre wärst wären wärt waere waeren", "haben": "habe hast hat haben habt hatte hattest hatten hattet habest hätte hättest hätten hättet haette haetten",
    "werden": "werde wirst wird werden werdet wurde wurden werdest würde würdest würden würdet wuerde wuerden", "können": "kann kannst können könnt konnte konnten könne könnest könnte könntest könnten könntet koennte koennten",
    "müssen": "muss musst müssen müsst musste mussten müsse müssest müsste müsstest müssten muesste muessten", "dürfen": "darf dürfen durfte durften dürfe dürfte dürften duerfte", "sollen": "soll sollst sollen sollte sollten solle sollest",
    "wollen": "will willst wollen wollte wollten wolle", "mögen": "mag mögen mochte möge möchte möchtest möchten möchtet moechte",
}
_LEMMA = {w: lemma for lemma, words in LEMMAS.items() for w in words.split()}

# --- suffixes -> (tag, cost, letters to cut for the lemma, what to add); "" fits every word; fixed values
UPPER = {
    "": (("N.nom", 0.2, 0, ""), ("E", 1.0, 0, ""), ("A", 3.0, 0, "")),
    "s": (("N.gen", 0.3, 1, ""), ("N.nom", 0.6, 0, ""), ("S", 0.8, 1, ""), ("E", 1.2, 0, "")),
    "es": (("N.gen", 0.2, 2, ""), ("N.nom", 0.9, 0, ""), ("S", 1.2, 1, "")),
    "ss": (("N.nom", 0.2, 0, ""), ("E", 1.0, 0, "")),
    "us": (("N.nom", 0.2, 0, ""), ("E", 0.8, 0, "")),
    "ung": (("N.nom", 0.1, 0, ""),), "heit": (("N.nom", 0.1, 0, ""),), "keit": (("N.nom", 0.1, 0, ""),), "ungen": (("N.nom", 0.1, 2, ""),), "schaft": (("N.nom", 0.1, 0, ""),),
}
LOWER = {
    "": (("adv", 1.0, 0, ""), ("A", 1.2, 0, ""), ("V.ind", 1.5, 0, "")),
    "e": (("A", 0.7, 1, ""), ("V.1", 0.8, 1, "en"), ("V.k1", 1.0, 1, "en"), ("adv", 2.0, 0, "")),
    "en": (("inf", 0.5, 0, ""), ("A", 0.8, 2, ""), ("V.ind", 0.7, 0, ""), ("V.k1", 3.0, 0, "")),
    "er": (("A", 0.4, 2, ""), ("adv", 1.5, 0, "")), "es": (("A", 0.3, 2, ""),), "em": (("A", 0.3, 2, ""),),
    "t": (("V.ind", 0.4, 1, "en"), ("part", 1.2, 0, ""), ("adv", 1.5, 0, ""), ("A", 1.6, 0, "")),
    "st": (("V.ind", 0.5, 2, "en"), ("A", 1.4, 0, "")), "te": (("V.ind", 0.4, 2, "en"), ("A", 1.0, 1, ""), ("V.k2", 1.8, 2, "en")), "ten": (("V.ind", 0.5, 3, "en"), ("inf", 0.7, 0, ""), ("A", 1.0, 2, ""), ("V.k2", 1.9, 3, "en")),
    "lich": (("A", 0.2, 0, ""),), "ig": (("A", 0.2, 0, ""),), "isch": (("A", 0.2, 0, ""),), "bar": (("A", 0.2, 0, ""),), "sam": (("A", 0.2, 0, ""),), "los": (("A", 0.2, 0, ""),), "haft": (("A", 0.2, 0, ""),),
    "weise": (("adv", 0.1, 0, ""),), "ung": (("N.nom", 0.5, 0, ""),),
}
_PARTICIPLE = ("ge", "be", "ver", "er", "ent", "zer", "emp", "miss")

#: Tagged sentences that transitions are counted in to begin with.
TAGGED = """
Der/D.nom Mann/N.nom geht/V.ind ./Q  Die/D.nom Frau/N.nom liest/V.ind das/D.acc Buch/N.nom ./Q  Ich/R1 sehe/V.1 den/D.acc Hund/N.nom ./Q  Er/R3 kommt/V.ind heute/adv ./Q  Wir/R gehen/V.ind nach/P Hause/N.nom ./Q
Das/D.nom Dach/N.nom des/D.gen Hauses/N.gen ist/X.ind rot/A ./Q  Die/D.nom Farbe/N.nom der/D.gen Tür/N.nom ist/X.ind schön/A ./Q  Die/D.nom Meinung/N.nom der/D.gen alten/A Frau/N.nom zählt/V.ind ./Q  Peters/S Auto/N.nom steht/V.ind hier/adv ./Q  Annas/S Buch/N.nom liegt/V.ind auf/P dem/D.dat Tisch/N.nom ./Q
Wegen/P.gen des/D.gen Regens/N.gen bleiben/V.ind wir/R hier/adv ./Q  Trotz/P.gen der/D.gen Kälte/N.nom gehen/V.ind sie/R3 ./Q  Innerhalb/P.gen einer/D.gen Woche/N.nom kommt/V.ind er/R3 ./Q  Wir/R gedenken/V.ind der/D.gen Opfer/N.nom ./Q  Er/R3 ist/X.ind sich/R seiner/D.gen Schuld/N.nom bewusst/A ./Q
Er/R3 sagte/V.ind ,/Q er/R3 sei/X.k1 krank/A ./Q  Sie/R3 sagt/V.ind ,/Q dass/K er/R3 komme/V.k1 ./Q  Er/R3 sagte/V.ind ,/Q er/R3 habe/X.k1 keine/D.acc Zeit/N.nom ./Q  Sie/R3 meint/V.ind ,/Q er/R3 gehe/V.k1 nach/P Hause/N.nom ./Q  Es/R3 lebe/V.k1 der/D.nom König/N.nom !/Q
Wenn/K ich/R1 reich/A wäre/X.k2 ,/Q hätte/X.k2 ich/R1 ein/D.acc Haus/N.nom ./Q  Ich/R1 würde/X.k2 gehen/inf ./Q  Das/D.nom könnte/X.k2 helfen/inf ./Q  Er/R3 käme/V.k2 gern/adv ./Q  Ich/R1 habe/X.ind das/D.acc Buch/N.nom gelesen/part ./Q  Der/D.nom Antrag/N.nom wird/X.ind geprüft/part ./Q
Ich/R1 gehe/V.1 in/P die/D.acc Stadt/N.nom ./Q  Mit/P der/D.dat Bahn/N.nom fährt/V.ind er/R3 zur/P Arbeit/N.nom ./Q  Der/D.nom kleine/A Hund/N.nom und/C die/D.nom große/A Katze/N.nom schlafen/V.ind ./Q  Das/D.nom Kind/N.nom ,/Q das/W lacht/V.ind ,/Q ist/X.ind müde/A ./Q  Er/R3 will/X.ind das/D.acc Haus/N.nom kaufen/inf ./Q
Ich/R1 glaube/V.1 ,/Q dass/K er/R3 kommt/V.ind ./Q  Ich/R1 bleibe/V.1 ,/Q weil/K es/R3 regnet/V.ind ./Q  Sie/R3 geht/V.ind nicht/adv zu/P Fuß/N.nom ./Q  In/P 3/M Tagen/N.nom kommt/V.ind Anna/E ./Q  Anna/E und/C Peter/E lachen/V.ind ./Q  Er/R3 versucht/V.ind zu/Z schlafen/inf ./Q
Er/R3 sagte/V.ind ,/Q er/R3 könne/X.k1 kommen/inf ./Q  Sie/R3 meint/V.ind ,/Q er/R3 solle/X.k1 nicht/adv gehen/inf ./Q  Er/R3 sagt/V.ind ,/Q er/R3 habe/X.k1 gewonnen/part ./Q  Er/R3 hätte/X.k2 das/D.acc Haus/N.nom gekauft/part ./Q
"""  # noqa: RUF001


@lru_cache(maxsize=1)
def first_counts() -> np.ndarray:
    """Pairs of neighbouring tags in the tagged sentences; row len(TAGS): the beginning of a sentence."""
    n = np.zeros((len(TAGS) + 1, len(TAGS)))
    before = len(TAGS)
    for pair in TAGGED.split():
        tag = _T[pair.rsplit("/", 1)[1]]
        n[before, tag] += 1
        before = len(TAGS) if pair.startswith(("./", "!/")) else tag
    return n


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative logarithms of the shares of what follows a tag, each count higher by 0.1."""
    n = counts + 0.1
    return -np.log(n / n.sum(1, keepdims=True))


class Trie:
    """Suffixes, letter by letter from the end; the longest one that fits gives a word's candidates."""

    def __init__(self, table: dict[str, tuple]) -> None:
        self.root: dict = {}
        for suffix, own in table.items():
            node = self.root
            for c in reversed(suffix):
                node = node.setdefault(c, {})
            node[""] = own

    def __call__(self, word: str) -> tuple:
        node, found = self.root, self.root.get("", ())
        for c in reversed(word[1:]):  # a suffix leaves a letter
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        return found


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, list[tuple[str, float]]], Trie, Trie]:
    closed: dict[str, list[tuple[str, float]]] = {}
    for tag, words in CLOSED.items():
        for w in words.split():
            closed.setdefault(w, []).append((tag, _ASIDE.get(tag, 0.0)))
    return closed, Trie(UPPER), Trie(LOWER)


@lru_cache(maxsize=1 << 16)
def _ranked(first: bool, small: bool, closed: tuple, upper: tuple, lower: tuple, participle: bool) -> tuple[tuple[int, float, int, str], ...]:
    """(tag, cost, cut, add) of the candidates of all words alike in this: their entries in the closed classes and in the tries. A lemma is made by cut and add; cut: -1 of the closed class, from ``_LOW`` on of the word in lower case."""
    out = [(_T[t], c, -1, "") for t, c in closed]
    if out and (first or small):
        return tuple(sorted(out, key=lambda x: x[1])[:MOST])
    out += [(_T[t], c, cut, add) for t, c, cut, add in upper]
    if small or first:
        more = 0.0 if small else 1.0
        own = [(_T[t], c + more, cut + _LOW, add) for t, c, cut, add in lower]
        if participle:
            own = [(_T["part"], 0.2 + more, _LOW, "")] + [(t, c + 1.2, cut, add) for t, c, cut, add in own if t != _T["part"]]
        out += own
    best: dict[int, tuple[int, float, int, str]] = {}
    for x in sorted(out, key=lambda x: x[1]):
        best.setdefault(x[0], x)
    # letters that are neither capital nor small, as in other scripts: a name
    return tuple(list(best.values())[:MOST]) or ((_T["E"], 0.0, 0, ""),)


_LOW = 1 << 10
_SIGNS = {t: ((_T[t], 0.0, 0, ""),) for t in ("M", "Q")}


def _told(word: str, first: bool) -> tuple[tuple[int, float, int, str], ...]:
    head = word[0]
    if not head.isalpha():
        return _SIGNS["M" if head.isdigit() else "Q"]
    closed, upper, lower = _tables()
    low, small = word.lower(), head.islower()
    own = closed.get(low, ())
    if own and (first or small):
        return _ranked(first, small, tuple(own), (), (), False)
    below = small or first
    return _ranked(first, small, tuple(own), upper(word) if head.isupper() else (), lower(low) if below else (), below and len(low) > 5 and low.endswith(("t", "en")) and low.startswith(_PARTICIPLE))


def _lemma(word: str, cut: int, add: str) -> str:
    low = word.lower() if cut < 0 or cut >= _LOW else word
    if cut < 0:
        return _LEMMA.get(low, low)
    cut &= _LOW - 1
    return low[: len(low) - cut] + add


def candidates(word: str, first: bool) -> tuple[tuple[int, float, str], ...]:
    """(tag, cost, lemma) of a word; ``first``: it begins a sentence, where a capital tells nothing."""
    return tuple((t, c, _lemma(word, cut, add)) for t, c, cut, add in _told(word, first))


def decoded(tag: np.ndarray, cost: np.ndarray, sizes: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The cheapest candidate of each word. tag, cost: words x MOST (an infinite cost: none); sizes: words of each sentence; of equal ones the first candidates, decided from the end."""
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    many, longest = len(size), int(size[0]) if len(size) else 0
    on = np.searchsorted(-size, -np.arange(longest), side="left")
    # places of sentences lie together: those of the first words, then of the second ones
    begin = np.cumsum(on) - on
    place = np.empty(many, np.int64)
    place[order] = np.arange(many)
    sentence = np.repeat(np.arange(many), sizes)
    at = begin[np.arange(len(tag)) - (np.cumsum(sizes) - sizes)[sentence]] + place[sentence]
    x, own = np.empty((MOST, len(tag))), np.empty((MOST, len(tag)), tag.dtype)
    x[:, at], own[:, at] = cost.T, tag.T
    x[:, :many] += between[len(TAGS)][own[:, :many]]
    flat, a = between.ravel(), 0
    bounds = list(zip(on.tolist(), begin.tolist(), strict=True))
    for n, b in bounds[1:]:
        x[:, b : b + n] += np.minimum.reduce(x[:, None, a : a + n] + flat[own[:, None, a : a + n] * len(TAGS) + own[None, :, b : b + n]])
        a = b
    best = np.empty(len(tag), np.int64)
    more = 0
    for n, a in reversed(bounds):
        # sentences that end here; the others go on where the next words' tags come from
        best[a + more : a + n] = x[:, a + more : a + n].argmin(0)
        if more:
            then = own[best[b : b + more], np.arange(b, b + more)]
            best[a : a + more] = (x[:, a : a + more] + flat[own[:, a : a + more] * len(TAGS) + then]).argmin(0)
        more, b = n, a
    return best[at]


class Analysed:
    """The tags of a batch's tokens. With ``wanted`` tags, only sentences that may have one of them are decoded; other tokens have tag -1."""

    def __init__(self, s: Scanned, between: np.ndarray, wanted: np.ndarray | None = None) -> None:
        first = np.zeros(len(s.word), bool)
        first[s.first[:-1]] = True
        distinct, back = np.unique(s.word * 2 + first, return_inverse=True)
        self.words = s.text.take(pa.array(distinct // 2)).to_pylist()
        self.own = [_told(w, f) for w, f in zip(self.words, (distinct % 2 == 1).tolist(), strict=True)]
        many = np.fromiter(map(len, self.own), np.int64, len(self.own))
        which = np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        tag, cost = np.zeros((len(many), MOST), np.int64), np.full((len(many), MOST), np.inf)
        tag[which] = [c[0] for cs in self.own for c in cs]
        cost[which] = [c[1] for cs in self.own for c in cs]
        sizes, told = np.diff(s.first), np.ones(len(s.word), bool)
        if wanted is not None and len(sizes):
            may = np.logical_or.reduceat((np.isin(tag, wanted) & (cost < np.inf)).any(1)[back], s.first[:-1])
            told, sizes = np.repeat(may, sizes), sizes[may]
        self.back, self.best = back, np.zeros(len(back), np.int64)
        back = back[told]
        best = self.best[told] = decoded(tag[back], cost[back], sizes, between)
        self.tag = np.full(len(told), -1, np.int64)
        self.tag[told] = tag[back, best]

    def lemmas(self, a: int = 0, b: int | None = None) -> list[str]:
        """Of the tokens from ``a`` to ``b``."""
        return [_lemma(self.words[k], *self.own[k][j][2:]) for k, j in zip(self.back[a:b].tolist(), self.best[a:b].tolist(), strict=True)]


def analysed(s: Scanned, between: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Tag and lemma of each token of a batch."""
    found = Analysed(s, between)
    return found.tag, found.lemmas()


def analyses(docs: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """doc_id, sent_no, i, t_start, t_end, text, tag, lemma of each token of ``docs`` (doc_id, text)."""
    between = costs(first_counts() if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(TAGS)
        for batch in batches:
            s = Scanned(batch)
            if len(s.word):
                tag, lemma = analysed(s, between)
                i, start, end, text, *_ = s.columns(np.arange(len(s.word)))
                doc = pa.array(np.array(s.doc, np.int64)[s.sentence])
                yield pa.RecordBatch.from_arrays([s.doc_ids.take(doc), pa.array(np.array(s.numbers)[s.sentence], pa.int32()), i, start, end, text, names.take(pa.array(tag)), pa.array(lemma, pa.string())], names=["doc_id", "sent_no", "i", "t_start", "t_end", "text", "tag", "lemma"])

    return batched(docs).mapInArrow(run, "doc_id bigint, sent_no int, i int, t_start int, t_end int, text string, tag string, lemma string")


def counted(docs: DataFrame, counts: np.ndarray | None = None) -> np.ndarray:
    """Pairs of neighbouring tags in the best sequences of ``docs``, added to those of the tagged sentences: each task sums a table of fixed size."""
    between = costs(first_counts() if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(TAGS) + 1) * len(TAGS), np.int64)
        for batch in batches:
            s = Scanned(batch)
            if len(s.word):
                tag = Analysed(s, between).tag
                before = np.concatenate([[0], tag[:-1]])
                before[s.first[:-1]] = len(TAGS)
                n += np.bincount(before * len(TAGS) + tag, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["pair", "n"])

    rows = batched(docs).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # (tags + 1) x tags at most
    out = first_counts().copy()
    for r in rows:
        out[r.pair // len(TAGS), r.pair % len(TAGS)] += r.n
    return out


# --- genitives by what governs them, subjunctives by function

GENITIVE_VERBS = ("gedenken", "gedachten", "gedenkt", "gedachte", "bedarf", "bedürfen", "bedurfte", "entbehrt", "entbehren", "rühmt", "rühmen", "enthält", "annehmen", "beschuldigt", "angeklagt", "erinnern", "harren", "harrt")
GENITIVE_ADJECTIVES = ("bewusst", "würdig", "fähig", "mächtig", "müde", "sicher", "gewiss", "überdrüssig", "schuldig", "verdächtig", "kundig", "unwürdig")


def _genitives(tags: list[str], lower: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first token, last token, kind) of a sentence's genitives."""
    i = 0
    while i < len(tags):
        if tags[i] == "S" and i + 1 < len(tags) and tags[i + 1] in ("N.nom", "N.gen", "A", "E"):
            yield i, i, "Sächsischer Genitiv"
        elif tags[i] == "D.gen":
            j = i + 1
            while j < len(tags) and tags[j] == "A":
                j += 1
            if j < len(tags) and tags[j] in ("N.nom", "N.gen", "E", "S"):
                after = lower[j + 1] if j + 1 < len(tags) else ""
                if i and tags[i - 1] == "P.gen":
                    kind = "Präpositionaler Genitiv"
                elif after in GENITIVE_ADJECTIVES:
                    kind = "Adjektiv-regierter Genitiv"
                elif not (i and tags[i - 1] in ("N.nom", "N.gen", "E")) and any(w in GENITIVE_VERBS for w in lower):
                    kind = "Verbal-regierter Genitiv"
                else:
                    kind = "Genitiv-Konstruktion"
                yield i, j, kind
                i = j
        i += 1


_CONDITION = ("wenn", "falls", "sofern")


def _subjunctives(tags: list[str], lower: list[str], lemma: list[str]) -> Iterator[tuple[int, str, str]]:
    """(token, kind, function) of a sentence's subjunctives: eight classes by mood, verb and clause, in their order."""
    clause, clauses = 0, []
    for k, w in enumerate(lower):
        clause += w in (",", ";", ":")
        clauses.append(clause)
    begins = {c: clauses.index(c) for c in set(clauses)}
    of = lambda c: [k for k in range(len(tags)) if clauses[k] == c]
    opener = {c: next((lower[k] for k in of(c) if tags[k] in ("K", "W") and k - begins[c] <= 2), "") for c in begins}
    conditional = any(o in _CONDITION for o in opener.values())
    for k, t in enumerate(tags):
        if not t.endswith((".k1", ".k2")):
            continue
        if lower[k] == "sei" and 0 < k < len(lower) - 1 and (lower[k - 1], lower[k + 1]) == ("es", "denn"):
            continue
        c, past, aux = clauses[k], t.endswith("k2"), t.startswith("X")
        said = c > 0 and opener[c] in ("", "dass", "ob") and any(tags[j] in ("V.ind", "V.1") for j in of(c - 1))
        if not past and said:
            yield k, "Konjunktiv I", "Indirekte Rede"
        elif past and opener[c] in _CONDITION:
            yield k, "Konjunktiv II", "Irrealis (Bedingung)"
        elif past and conditional and not opener[c]:
            yield k, "Konjunktiv II", "Irrealis (Hypothese)"
        elif past and lemma[k] == "werden":
            yield k, "Würde-Konstruktion (Konjunktiv II)", "Hypothese/Konditionalis"
        elif past and aux and lemma[k] not in ("haben", "sein"):
            yield k, "Konjunktiv II (Modal)", "Höflichkeit/Möglichkeit"
        elif not past and not opener[c]:
            yield k, "Konjunktiv I", "Wunsch/Optativ"
        elif past and aux:
            yield (k, "Konjunktiv II (Perfekt)", "Vergangenheitshypothese") if any(tags[j] == "part" for j in of(c)) else (k, "Konjunktiv II", "Irrealis/Hypothese")
        elif not past and opener[c]:
            yield k, "Konjunktiv I", "Nebensatz"
        else:
            yield k, "Konjunktiv II" if past else "Konjunktiv I", "Unbestimmt"


_GENITIVE = [_T[t] for t in TAGS if t in ("S", "D.gen")]
_SUBJUNCTIVE = [_T[t] for t in TAGS if t.endswith((".k1", ".k2"))]


def governed(docs: DataFrame, counts: np.ndarray | None = None, rules: tuple[str, ...] = ("genitiv", "konjunktiv")) -> DataFrame:
    """doc_id, rule (genitiv or konjunktiv), sent_no, t_start, t_end, term, kind, function of the genitives and subjunctives of ``docs``, or of one of the two."""
    between = costs(first_counts() if counts is None else counts)
    wanted = np.array((_GENITIVE if "genitiv" in rules else []) + (_SUBJUNCTIVE if "konjunktiv" in rules else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Scanned(batch)
            out: list[tuple] = []
            if len(s.word):
                own = Analysed(s, between, wanted)
                hit = np.isin(own.tag, wanted)
                lower = s.lower.to_pylist()
                for k in np.unique(s.sentence[hit]).tolist():
                    a, b = int(s.first[k]), int(s.first[k + 1])
                    tags, low = [TAGS[t] for t in own.tag[a:b].tolist()], [lower[w] for w in s.word[a:b].tolist()]
                    found = [("genitiv", i, j, kind, "") for i, j, kind in _genitives(tags, low)] if "genitiv" in rules else []
                    if "konjunktiv" in rules:
                        found += [("konjunktiv", i, i, kind, use) for i, kind, use in _subjunctives(tags, low, own.lemmas(a, b))]
                    for rule, i, j, kind, use in found:
                        start, end = int(s.start[a + i]), int(s.start[a + j] + s.length[s.word[a + j]])
                        out.append((s.doc[k], rule, s.numbers[k], start, end, s.texts[s.row[s.doc[k]]][start:end], kind, use))
            doc, *rest = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([s.doc_ids.take(pa.array(list(doc), pa.int64())), *(pa.array(list(c), k) for c, k in zip(rest, kinds, strict=True))], names=["doc_id", "rule", "sent_no", "t_start", "t_end", "term", "kind", "function"])

    return batched(docs).mapInArrow(run, "doc_id bigint, rule string, sent_no int, t_start int, t_end int, term string, kind string, function string")

