"""WARC round trip and personal data against plain versions."""

import base64
import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from stationwise.llm.common import new_path
from stationwise.llm.pii import find_private, find_spans, luhn, mod97
from stationwise.llm.warc import WarcConfig, read_archives, write_archives

PAGES = [
    (5, "http://a/", "<p>same</p>"),
    (3, "http://b/\r\nX: y", "<p>same</p>"),
    (8, None, "<p>same</p>"),
    (1, "http://c/", "tricky\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nétude 日本"),
    (2, "http://d/", None),
    (4, "http://e/", ""),
    (None, "http://f/", "<p>same</p>"),
    (None, "http://g/", "nobody else"),
    (6, "http://h/", "long " * 50_000),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("check", F.lit(0))
    path = new_path(spark, "archives")
    write_archives(pages, path, WarcConfig(file_records=2, written_at=dt.datetime(2020, 1, 2)))
    found = read_archives(spark, path).collect()
    expected = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        text = None if page is None else str(page)
        expected.append((text, len(payload), digest, "revisit" if revisit else "response", str(first) if revisit else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(r.intact for r in found)


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = new_path(spark, "archives")
    write_archives(pages, path, WarcConfig(min_bytes=12))
    assert read_archives(spark, path).where("record_type = 'revisit'").count() == 0


def test_archives_of_no_page(spark):
    path = new_path(spark, "archives")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0


# The contract's patterns as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if good():
                found.append((m.start(), place, m.end(), kind))
    return sorted(found)


TEXTS = [
    "write to a.b@c.de, x@y.z@w.com_foo@z.de and @nobody or a@b",
    "hosts 1.2.3.4 and 256.1.1.1, 001.002.003.004.5 and 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111",
    "call +49 (30) 123-4567.89 or +1 2, +12345678901234567890",
    "é日 mail: é@b.de ü.x@b-c.d.e 💡 4111111111111111",
    "DE89 3704 0044 0532 0130 00 is an IBAN, SSN 123-45-6789",
    "order 123-45-6789",
    "+" * 50 + "1" * 5000 + "." * 5000,
    "a" * 30_000,
    "",
]


def test_base_spans_equal_the_plain_patterns():
    for text in TEXTS:
        base = [s[:4] for s in find_spans(text) if s[3] in PLAIN]
        assert base == plain_spans(text), text[:60]


def test_checksums_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE89370400440532013001")
    kinds = [(s[3], s[4]) for s in find_spans(TEXTS[5])]
    assert ("iban", 1.0) in kinds and ("ssn", 0.7) in kinds
    assert not find_spans(TEXTS[6])


def test_report_per_document(spark):
    rows = [(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[2]), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    found = {(r.doc_id, r.n_email, r.n_card, r.spans): r for r in find_private(frame).collect()}
    emails = ",".join(f"email:{s[0]}:{s[2]}" for s in plain_spans(TEXTS[0]))
    assert found[(1, 3, 0, emails)].base_sha256 == hashlib.sha256(emails.encode()).hexdigest()
    assert (None, 0, 1, "card:5:24") in found
    assert found[(4, 0, 0, "")].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert find_private(frame.limit(0)).count() == 0
