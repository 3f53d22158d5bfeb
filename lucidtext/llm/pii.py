r"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) are exactly the given patterns, leftmost and
without overlap within a kind; those that pass their check stay whatever their score.
The method adds further kinds: ``iban`` (its country's length and mod-97) and ``tax`` (eleven digits with the
ISO 7064 mod 11,10 check digit), which stay from a score of ``MIN_SCORE``. A score is
the kind's own plus ``NEAR`` if one of its words, as a whole word, stands within
``REACH`` characters of the span.

Patterns run in linear time on any text: a number begins only where no digit stands
before it, and an address is found from its @. Null and empty texts have no spans.
Offsets are code points, ends exclusive. Rows that repeat give the same result each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from ._shared import bound_batches, table

KINDS = ("email", "ip", "card", "phone", "iban", "tax")
BASE = KINDS[:4]
#: Score of a span that passes its check, and words that raise it.
OWN = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "tax": 0.3}
#: Whole words; * stands for what a compound or an inflection adds.
WORDS = {
    "email": ("mail", "e-mail*", "email*", "mailto", "kontakt*", "contact*", "correo", "courriel"),
    "ip": ("ip", "ips", "server*", "host", "hosts", "address*", "adress*"),
    "card": ("card*", "karte*", "kreditkarte*", "visa", "carte*", "tarjeta*"),
    "phone": ("phone*", "telephone*", "telefon*", "téléphone", "tel", "call", "anruf*", "mobil*"),
    "iban": ("iban", "konto*", "account*", "cuenta*", "compte*"),
    "tax": ("tax", "taxes", "steuer*", "impôt*", "fiscal*"),
}
NEAR, REACH, MIN_SCORE = 0.3, 40, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}")
#: Characters of an IBAN by country, as its registry has them; fixed values.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20"
    " LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_TAX = re.compile(r"(?<![0-9])[0-9]{11}(?![0-9])")
_CONTEXT = {kind: re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w).replace(r"\*", r"\w*") for w in own) + r")(?!\w)") for kind, own in WORDS.items()}
_FIRST, _LAST = re.compile(r"^\w+"), re.compile(r"\w+$")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod11_10(digits: str) -> bool:
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @, back over the local part, on over the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """As many letters and digits as the country's IBANs have, single blanks between them, and then no more."""
    out, free = [], 0
    for m in _IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[0][:2].upper())
        rest = _IBAN_REST[n].match(text, m.end()) if n and m.start() >= free else None
        if rest and mod97(text[m.start() : rest.end()]):
            free = rest.end()
            out.append((m.start(), free))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _proposed(text: str) -> list[tuple[int, int, str]]:
    """All spans that pass their check."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    found += [(a, b, "iban") for a, b in _ibans(text)]
    found += [(m.start(), m.end(), "tax") for m in _TAX.finditer(text) if mod11_10(m[0])]
    return found


def _around(text: str, start: int, end: int) -> str:
    """What stands near a span, in lower case, without words that the limit cuts."""
    a, b = max(0, start - REACH), min(len(text), end + REACH)
    before, after = text[a:start], text[end:b]
    if a and text[a - 1].isalnum():
        before = _FIRST.sub("", before)
    if b < len(text) and text[b].isalnum():
        after = _LAST.sub("", after)
    return f"{before} {after}".lower()


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all personal data, by start and then kind as listed."""
    if not text:
        return []
    out = []
    for start, end, kind in _proposed(text):
        around = _around(text, start, end)
        score = min(1.0, OWN[kind] + NEAR * bool(_CONTEXT[kind].search(around)))
        if kind in BASE or score >= MIN_SCORE:
            out.append((start, end, kind, round(score, 2)))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


@F.arrow_udf(from_arrow_type(_SPANS))
def pii_spans(texts: pa.Array) -> pa.Array:
    """All spans of each text."""
    return pa.array([[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in spans(t)] for t in texts.to_pylist()], _SPANS)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


@F.arrow_udf(StringType())
def pii_masked(texts: pa.Array) -> pa.Array:
    return pa.array([masked(t) for t in texts.to_pylist()], pa.string())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row. Null and empty texts have no spans; spans that begin together stand in the order of kinds; repeated rows get the same result; without documents no rows."""
    bound_batches(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", pii_spans("text").alias("s"))
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    by_kind = {kind: F.filter("s", lambda x: x["kind"] == F.lit(kind)) for kind in BASE}  # noqa: B023  called at once
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(only).cast("long").alias(f"n_{kind}") for kind, only in by_kind.items()),
        F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("s", said)).alias("spans"),
        F.transform("s", lambda x: x["score"]).alias("scores"),
    )
