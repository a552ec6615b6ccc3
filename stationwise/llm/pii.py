"""Operator 10, personal data: patterns propose, checksums confirm, context adjusts.

Base kinds (email, ip, card, phone) are reported wherever their pattern and their
validator agree; context only moves their score. The method adds kinds: ``iban``
(mod-97) and ``ssn`` (no checksum, so it needs context), kept from a score on.
Spans are code points, end exclusive, leftmost and non-overlapping per kind.

Cases: null text counts as empty; a document without spans has an empty span list
and the digest of the empty string; every text is scanned whole in time linear in
its length; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stationwise.llm.common import bounded_batches, table

# The kinds in the order of the report, and their patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored at the head of a run of digits: same matches as the plain pattern, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Scores before context, and words that move them.
PLAIN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
FOR = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write)", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|client|login)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit|payment|pay|cvv)\b", re.I),
    "phone": re.compile(r"\b(tel|phone|call|mobile|fax|dial|whatsapp)", re.I),
    "iban": re.compile(r"\b(iban|bank|account|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social security|social-security)\b", re.I),
}
AGAINST = re.compile(r"\b(version|build|release|isbn|issn|order|serial|example|test)\b", re.I)
NEAR = 40
STEP = 0.2
SSN_STEP = 0.4
KEEP = 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs: a local part reaches back to the last end or foreign character."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for found in IP.finditer(text):
        parts = [p.lstrip("0") for p in found[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield found.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = NOT_DIGIT.sub("", found[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", found[0])) <= 15:
                yield found.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest groups of a candidate that pass mod-97."""
    for found in IBAN.finditer(text):
        groups = found[0]
        while groups:
            if 15 <= len(account := groups.replace(" ", "")) <= 34 and mod97(account):
                yield found.start(), found.start() + len(groups)
                break
            groups = groups.rpartition(" ")[0]


def ssns(text: str) -> Iterator[tuple[int, int]]:
    return (found.span() for found in SSN.finditer(text))


PROPOSERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(kind: str, text: str, start: int, end: int) -> float:
    """The plain score of the kind, moved by words near the span, within 0 and 1."""
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    value = PLAIN_SCORE[kind]
    if FOR[kind].search(near):
        value += SSN_STEP if kind == "ssn" else STEP
    if AGAINST.search(near):
        value -= STEP
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """All spans as (start, kind's place, end, kind, score), by start and kind."""
    found = []
    for place, kind in enumerate(KINDS):
        for start, end in PROPOSERS[kind](text):
            sure = score(kind, text, start, end)
            if kind in BASE_KINDS or sure >= KEEP:
                found.append((start, place, end, kind, sure))
    return sorted(found)


REPORT = (
    "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "scores string, n_iban long, n_ssn long"
)


def find_private(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per kind, the digest of the base spans, all spans and their scores."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                spans = find_spans(value) if isinstance(value, str) else []
                named = [f"{kind}:{start}:{end}" for start, _, end, kind, _ in spans]
                base = ",".join(n for n, s in zip(named, spans) if s[3] in BASE_KINDS)
                counts = [sum(s[3] == kind for s in spans) for kind in KINDS]
                digest = hashlib.sha256(base.encode()).hexdigest()
                rows.append((doc_id, *counts[:4], digest, ",".join(named), ",".join(f"{s[4]:.2f}" for s in spans), *counts[4:]))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
            yield frame.assign(doc_id=pd.Series(batch.iloc[:, 0].to_numpy(), dtype=batch.dtypes.iloc[0]))

    bounded_batches(docs.sparkSession)
    kind = docs.schema[identifier].dataType.simpleString()
    return docs.select(identifier, text).mapInPandas(scan, REPORT.format(id=kind))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_private(table(spark, folder, "documents"))
