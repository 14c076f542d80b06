"""Personal data and secrets in texts: regular expressions propose, checksums confirm, context words adjust the score.

The four base kinds are always reported, with their score. Every added kind is reported only if its
score reaches the threshold, and words near it can decide that either way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans of one start are listed; the first four are always reported.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
#: Code points to both sides of a span in which context words count.
NEAR = 40
#: What a span needs beyond the base kinds.
THRESHOLD = 0.5
# Words that make a kind likelier when they stand near.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "bearer", "credential", "credentials", "private", "contraseña", "passwort", "clave"),
}
# Words that make a kind less likely when they stand near.
AGAINST = {
    "iban": ("invoice", "order", "serial", "model", "part"),
    "ssn": ("isbn", "order", "serial", "part", "invoice", "version"),
    "secret": ("commit", "checksum", "digest", "sha", "md5", "etag", "revision", "hash", "uuid"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "ssn": 0.3, "secret": 0.3}
#: What a confirmed checksum (of a secret: a known prefix) and words near a span add and take.
CONFIRMED, NEAR_WORD = 0.1, 0.3
#: Bits for each character below which a run of characters is no secret.
RANDOM = 3.0

_TRACE = re.compile("[0-9@]|-----BEGIN")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits whose first digit begins none; the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# Characters of an account number by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_LENGTHS.values()}}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
# Runs of characters of tokens; a match can't begin inside a run.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_HEADER = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})")
# How tokens of well-known services begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "hf_", "npm_")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: list[int]) -> bool:
    """Whether the check digit of a card number fits."""
    total = sum(digits[-1::-2])
    return (total + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of an international account number fit."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def entropy(text: str) -> float:
    """Bits for each character by how often the text has each."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def _secrets(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Runs that look drawn at random, with what their shape adds to the score."""
    for m in _HEADER.finditer(text):
        yield "secret", m.start(), m.end(), 0.6
    for m in _TOKEN.finditer(text):
        run = m[0]
        if not any(map(str.isdigit, run)) or not any(map(str.isalpha, run)) or entropy(run) < RANDOM:
            continue
        if run.startswith(PREFIXES):
            yield "secret", m.start(), m.end(), 0.4
        elif _HEX.fullmatch(run) or (any(map(str.isupper, run)) and any(map(str.islower, run))):
            yield "secret", m.start(), m.end(), 0.0


def _digits(text: str) -> list[int]:
    return [int(c) for c in _DIGIT.findall(text)]


def _proposed(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, what a checksum or the shape adds to the score)"""
    yield from (("email", a, b, 0.0) for a, b in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end(), 0.0
    for m in _CARD.finditer(text):
        if 12 <= len(_DIGIT.findall(m[0])) <= 19 and luhn(_digits(m[0])):
            yield "card", m.start(), m.end(), CONFIRMED
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield "phone", m.start(), m.end(), 0.0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST[IBAN_LENGTHS[m[1]]].match(text, m.end()) if m[1] in IBAN_LENGTHS else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield "iban", m.start(), rest.end(), CONFIRMED
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), 0.0
    yield from _secrets(text)


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by start and then in the order of KINDS; offsets are code points."""
    found = []
    if text and _TRACE.search(text):
        for kind, a, b, more in _proposed(text):
            near = {w.lower() for w in _WORD.findall(text[max(0, a - NEAR) : a] + "\n" + text[b : b + NEAR])}
            words = any(w in near for w in CONTEXT[kind]) - any(w in near for w in AGAINST.get(kind, ()))
            score = min(1.0, max(0.0, PRIOR[kind] + more + NEAR_WORD * words))
            if kind in BASE or score >= THRESHOLD:
                found.append(Span(kind, a, b, round(score, 3)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for s in found:
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, mask: bool = False) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs(doc_id, text)``, with ``masked`` text if asked for.

    A span has kind, start, end (code points, end exclusive) and score. Null and empty texts have none;
    every row is treated alone, so repeated rows and null ids are kept as they are. Other columns are
    not read. Time is linear in the length of a text, also for long runs of digits or letters.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for batch in batches:
            found, hidden = [], []
            for value in batch.column("text"):
                text = value.as_py()
                own = spans(text)
                found.append([{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in own])
                if mask:
                    hidden.append(text if text is None else masked(text, own))
            out = {"doc_id": batch.column("doc_id"), "spans": pa.array(found, kind)}
            yield pa.RecordBatch.from_pydict(out | ({"masked": pa.array(hidden, pa.string())} if mask else {}))

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, spans {SPANS}" + ", masked string" * mask)
