"""Operator 6, WARC revisit resolution: deduplicated archives with fresh headers.

Headers (identifier, payload digest, length), not payloads, are shuffled by
payload digest to find the original of every payload. Pages then meet the
resolved revisits by identifier, and Spark's text writer writes records: the
record separator is the writer's line separator, so every file is a valid
sequence of WARC records in a gzip stream, in any store Spark writes to. Files
hold a bounded number of records. Reading walks the records by Content-Length,
recomputes digests from the stored payloads, and joins revisits to the originals
by digest.

Cases: null html is an empty payload; null identifiers are never the smallest
and revisit a payload that some identified page has; rows that repeat the
smallest identifier are all responses; pages without url get an empty one;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, new_path, table, written

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, intact boolean"


@dataclass(frozen=True)
class WarcConfig:
    """Payloads below ``min_bytes`` are never revisited; ``file_records`` bounds an archive file."""

    min_bytes: int = 0
    file_records: int = 4000
    written_at: dt.datetime | None = None


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits are five hexadecimal or four base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_heads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, check, payload_bytes)"""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "*",
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.xxhash64("payload").alias("check"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def revisits(heads: DataFrame, config: WarcConfig) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_url) of the pages that repeat a payload."""
    key = ["payload_digest", "check", "payload_bytes"]
    slim = heads.where(F.col("payload_bytes") >= config.min_bytes).select("page_id", "url", *key)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    groups = slim.groupBy(*key).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    later = slim.select("page_id", *key).join(groups, key).where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return later.select(
        "page_id", "payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")
    ).distinct()


def header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value; line breaks in values are encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(CRLF)), F.lit(""))


def record_id(page: Column) -> Column:
    hexed = F.md5(F.coalesce(page.cast("string"), F.lit("")))
    parts = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(config: WarcConfig) -> Column:
    """A WARC record without the two line breaks that end it."""
    moment = (config.written_at or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("is_revisit")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.col("payload_bytes")),
        F.lit(CRLF),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", record_id(F.col("page_id"))),
        header("WARC-Date", F.lit(moment)),
        header("WARC-Target-URI", F.coalesce(F.col("url"), F.lit(""))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Page-ID", F.col("page_id")),
        header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        header("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
        header("WARC-Refers-To-Page", F.when(revisit, F.col("refers_to"))),
        header("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_url"))),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, config: WarcConfig = WarcConfig()) -> None:
    """Write one record per page; a payload is stored once, later pages refer to it."""
    heads = payload_heads(pages)
    slim = written(heads.drop("payload"), "heads")
    later = written(revisits(slim, config), "revisits")
    same = heads.page_id.eqNullSafe(later.page_id) & (heads.payload_digest == later.payload_digest)
    joined = heads.join(later, same, "left").select(
        *[heads[c] for c in heads.columns], "refers_to", "refers_url", F.col("refers_to").isNotNull().alias("is_revisit")
    )
    (
        joined.select(record_text(config).alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", CRLF + CRLF)
        .option("maxRecordsPerFile", config.file_records)
        .text(path)
    )


def parse_records(archive: io.BufferedIOBase) -> Iterator[tuple]:
    """Walk the records of one archive: rows of RECORDS."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.rstrip(b"\r\n").partition(b": ")
            fields[name.decode().lower()] = value.decode("utf-8", "replace")
        block = archive.read(int(fields["content-length"]))
        archive.read(4)
        payload = block.partition(b"\r\n\r\n")[2]
        stated, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            yield fields.get("warc-page-id"), kind, found, len(payload), None, found == stated
        else:
            yield fields.get("warc-page-id"), kind, stated, None, fields["warc-refers-to-page"], not payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, with revisits resolved to their original's payload."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as packed:
                    rows = list(parse_records(io.BufferedReader(packed)))
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"payload_bytes": "Int64"})

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    records = written(files.select("content").mapInPandas(walk, RECORDS), "records")
    responses = records.where("record_type = 'response'")
    originals = responses.select(
        "payload_digest", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes")
    ).distinct()
    resolved = (
        records.where("record_type = 'revisit'")
        .join(originals, ["payload_digest", "refers_to"], "left")
        .withColumn("intact", F.col("intact") & F.col("original_bytes").isNotNull())
        .withColumn("payload_bytes", F.col("original_bytes"))
    )
    return responses.unionByName(resolved.select(*responses.columns))


def op6_warc_revisit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    path = new_path(spark, "archives")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "intact",
    )


OP6_SQL = """
WITH hexed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
coded AS (
  SELECT page_id, payload, digest,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      list_sum([(instr('0123456789abcdef', substr(digest, (5 * (i // 4) + k + 1)::INT, 1)) - 1) * (16 ** (4 - k))::BIGINT
                for k in range(5)])::BIGINT // (32 ** (3 - i % 4))::BIGINT % 32)::INT, 1) for i in range(32)], '') AS payload_digest
  FROM hexed),
first AS (SELECT digest, min(page_id) AS original FROM coded GROUP BY digest)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to, true AS intact
FROM coded JOIN first USING (digest)
"""
