"""Personal data: patterns propose spans, checksums and structure confirm them, nearby words adjust the score.

Four base kinds (email, ip, card, phone) always count once their own condition holds.  Further kinds (bank account numbers,
social security numbers, IPv6 addresses, birth dates, phone numbers without a country) count from a score on: what the
pattern alone says, what its validator says, and words around it that speak for or against it.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, text_of

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.7
#: Code points before and after a span whose words are its context.
BEFORE, AFTER = 60, 30

# The base patterns.  The possessive forms match what the plain ones match, in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Kind(NamedTuple):
    """``alone``: score of a span the validator confirms, without context; a word for it adds ``word``, one against it takes it."""

    alone: float
    word: float
    near: frozenset[str]
    against: frozenset[str]


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_NUMBERING = _words("order invoice version release isbn issn part article sku item serial build chapter section figure ref bestellung "
                    "rechnung artikel commande facture pedido factura")
KINDS = {
    "email": Kind(0.95, 0.05, _words("email mail contact write correo courriel kontakt"), frozenset()),
    "ip": Kind(0.7, 0.2, _words("ip address host server client adresse login"), _words("version release build section chapter v")),
    "card": Kind(0.85, 0.15, _words("card credit debit visa mastercard amex karte carte tarjeta kreditkarte payment pay"), _NUMBERING),
    "phone": Kind(0.8, 0.15, _words("phone tel telephone call mobile fax cell telefon handy téléphone appelez teléfono llame"), _NUMBERING),
    "iban": Kind(0.9, 0.1, _words("iban account bank konto compte cuenta transfer"), _NUMBERING),
    "ssn": Kind(0.5, 0.3, _words("ssn social security sozialversicherung seguridad sécurité"), _NUMBERING),
    "ip6": Kind(0.75, 0.2, _words("ip ipv6 address host server client"), frozenset()),
    "birth": Kind(0.4, 0.4, _words("born birth birthday dob birthdate geboren geburtsdatum né née naissance nacido nacida nacimiento"), frozenset()),
    "local_phone": Kind(0.5, 0.3, _words("phone tel telephone call mobile fax cell telefon handy téléphone appelez teléfono llame"), _NUMBERING),
}


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number's check digits hold (ISO 7064, four leading characters moved to the end)."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the run before it, back to the last match or @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_DATE = re.compile(r"(?<![0-9./-])(?:([0-9]{1,2})([./-])([0-9]{1,2})\2((?:19|20)[0-9]{2})|((?:19|20)[0-9]{2})-([0-9]{2})-([0-9]{2}))(?![0-9/-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of the groups after a country code the longest run that has 15 to 34 characters and right check digits."""
    for m in _IBAN.finditer(text):
        whole = m[0][:68]  # 34 characters with a space after each
        for k in range(len(whole), 14, -1):
            after = text[m.start() + k:m.start() + k + 1]
            if not after.isalnum() and whole[k - 1] != " ":
                account = whole[:k].replace(" ", "")
                if 15 <= len(account) <= 34 and mod97(account):
                    yield m.start(), m.start() + k
                    break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _ip6s(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP6.finditer(text):
        try:
            address = ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if int(address) >> 112:  # not ::, ::1 and the like
            yield m.span()


def _births(text: str) -> Iterator[tuple[int, int]]:
    for m in _DATE.finditer(text):
        try:
            if m[5]:
                datetime.date(int(m[5]), int(m[6]), int(m[7]))
            else:
                day, month = sorted((int(m[1]), int(m[3])), reverse=True) if int(m[3]) > 12 else (int(m[1]), int(m[3]))
                datetime.date(int(m[4]), month, day)
        except ValueError:
            continue
        yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _LOCAL_PHONE.finditer(text))


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "ip6": _ip6s, "birth": _births,
    "local_phone": _local_phones}
ORDER = {kind: k for k, kind in enumerate(FINDERS)}


def score(kind: str, text: str, start: int, end: int) -> float:
    """0 to 1: the kind's own score, more with a word for it nearby, less with one against it."""
    own = KINDS[kind]
    around = {w.lower() for w in _WORDS.findall(text[max(0, start - BEFORE):start])}
    around.update(w.lower() for w in _WORDS.findall(text[end:end + AFTER]))
    value = own.alone + own.word * bool(around & own.near) - own.word * bool(around & own.against)
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str, threshold: float = THRESHOLD) -> tuple[list[Found], list[Found]]:
    """Base spans, and all spans: others are added from ``threshold`` on unless a base span covers them entirely."""
    if "@" not in text and not _DIGIT.search(text) and "::" not in text:
        return [], []
    order = lambda s: (s.start, ORDER[s.kind], s.end)
    base = sorted((Found(kind, a, b, score(kind, text, a, b)) for kind in BASE for a, b in FINDERS[kind](text)), key=order)
    starts, reach = [s.start for s in base], list(accumulate((s.end for s in base), max))
    added = []
    for kind in [k for k in FINDERS if k not in BASE]:
        for a, b in FINDERS[kind](text):
            before = bisect_right(starts, a)
            covered = before and reach[before - 1] >= b
            if not covered and (own := score(kind, text, a, b)) >= threshold:
                added.append(Found(kind, a, b, own))
    return base, sorted(base + added, key=order)


def told(spans: list[Found]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans) of every whole text.

    Null texts are empty and, as empty ones, hold nothing; repeated rows and rows without doc_id give a row each; other
    columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t, threshold) for t in b.column(1).to_pylist()]
            counts = [[sum(s.kind == k for s in base) for base, _ in found] for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([told(every) for _, every in found], pa.string()),
                 pa.array([",".join(f"{s.score:g}" for s in every) for _, every in found], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "scores"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(text: str, spans: list[Found]) -> str:
    """The text with every span put as its kind in brackets; overlapping ones as one, named by the first."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the personal data in ``text`` put as marks; null texts stay null, all other columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t in b.column(at).to_pylist():
                spans = find(t, threshold)[1] if t else []
                new.append(redact(t, spans) if spans else t)
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
