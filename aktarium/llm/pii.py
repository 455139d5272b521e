"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: The kinds in their order: those of the contract, then what the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# Score of a confirmed span without context, and the words nearby that raise or lower it (lower case, in four
# languages). Words count as a whole: "ship" isn't "ip".
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = {
    "email": ("example", "beispiel", "ejemplo", "exemple"),
    "ip": ("version", "release", "section", "chapter", "kapitel", "abschnitt", "capítulo", "chapitre"),
    "card": ("isbn", "serial", "tracking", "order", "seriennummer"),
    "phone": ("isbn", "version", "serial", "seriennummer"),
    "iban": ("example", "beispiel", "ejemplo", "exemple"),
    "ssn": ("part", "model", "serial", "isbn", "version"),
}
#: What a context word adds, what a word against takes, how many characters on each side of a span are searched for them (to
#: the end of the word that lies there), and the least score of an added span.
RAISE, LOWER, NEARBY, LEAST = 0.4, 0.2, 40, 0.5
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:-[^\W\d_]+)*")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs and look-behinds change no match (a run of digits can't end inside a match and go on after it), but keep
# the time in proportion to the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
# The length of a code by its country; those of other countries may have any length.
_IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FO FI GL NL",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT",
    26: "IS TR",
    27: "FR GR IT MC SM",
    28: "AL AZ CY DO GT HU LB PL",
    29: "BR PS QA UA",
    30: "JO KW MU",
    31: "MT",
}
_IBAN_LENGTHS = {c: n for n, cs in _IBAN_COUNTRIES.items() for c in cs.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled and cast out nines, sum to a multiple of ten."""
    ones = [int(c) for c in digits[-1::-2]]
    twos = [2 * int(c) for c in digits[-2::-2]]
    return (sum(ones) + sum(x - 9 * (x > 9) for x in twos)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the code, its first four characters moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the characters before it, back to the last match, and the domain behind it: no start is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Codes of their country's length, from each start that no code covers: what follows a code may look like its groups."""
    m = _IBAN.search(text)
    while m:
        start, end, after = m.start(), m.end(), m.start() + 1
        while end > start:
            code = text[start:end].replace(" ", "")
            whole = end == len(text) or not (text[end].isascii() and text[end].isalnum())
            if whole and 15 <= len(code) <= 34 and _IBAN_LENGTHS.get(code[:2], len(code)) == len(code) and mod97(code):
                yield start, end
                after = end
                break
            end = text.rfind(" ", start, end)
        m = _IBAN.search(text, after)


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": lambda t: (m.span() for m in _SSN.finditer(t))}


def _nearby(text: str, start: int, end: int) -> set[str]:
    """The words that begin within NEARBY characters before a span, and those that begin so near behind it; lower case."""
    behind = min(len(text), end + NEARBY)
    while behind < min(len(text), end + 2 * NEARBY) and text[behind].isalpha():
        behind += 1
    words = [*_WORD.findall(text, max(0, start - NEARBY), start), *_WORD.findall(text, end, behind)]
    return {w.lower() for w in words}


def find_spans(text: str | None) -> list[Span]:
    """All confirmed spans by kind and start, in code points, end exclusive. Base kinds stay whatever their score is."""
    text, out = text or "", []
    for kind in KINDS:
        for start, end in _FIND[kind](text):
            near = _nearby(text, start, end)
            score = round(PRIOR[kind] + RAISE * (not near.isdisjoint(CONTEXT[kind])) - LOWER * (not near.isdisjoint(AGAINST[kind])), 3)
            if kind in BASE or score >= LEAST:
                out.append(Span(kind, start, end, min(1.0, score)))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and `found`, an array of (kind, start, end, score, value).

    Null and empty texts have no spans. Rows are independent, so repeated rows, null ids and an empty table give repeated
    rows, null ids and no row. Other columns aren't read. Work is in proportion to a text's length for any text.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())])

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s._asdict() | {"value": t[s.start : s.end]} for s in find_spans(t)] for t in b.column("text").to_pylist()]
        return pa.record_batch([b.column("id"), pa.array(found, pa.list_(fields))], ["id", "found"])

    kind = narrow.schema["id"].dataType.simpleString()
    return in_batches(narrow, each, f"id {kind}, found array<struct<kind string, start long, end long, score double, value string>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans, all spans as text, their scores in the same order and the highest of these
    (0 without spans), from the rows of `find_pii`."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [_count(k) for k in BASE]
    others = [c for c in found.columns if c != "found"]
    best = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0))
    scores = F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",")
    return found.select(*others, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), scores.alias("scores"), best.alias("top_score"))


def _count(kind: str):
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
