"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, compressed; every record's header is kept as it is in a table of
its own, next to the address of its payload. A join of both gives the original records again, with their payloads
for revisits too. SHA-1 and length are gathered beside each address and must agree within it, and whatever is read
back is hashed again, so an address always stands for one payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertext.llm.common import shared_folder, stored, table

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:undertext:page:"
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIELD = re.compile(rb"^([A-Za-z-]+): (.*)$", re.M)


def base32_sha1(payload):
    """The bare base32 SHA-1 of a binary column: 160 bits as eight groups of 20, four digits each."""

    def digits(i):
        group = F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 10).cast("long")
        return [F.substring(F.lit(DIGITS), (F.shiftright(group, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[d for i in range(8) for d in digits(i)])


def headers(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, address, digest, length, refers_to) of every row; refers_to is null for responses.

    Only digests travel. The owner of an address is its largest page_id, and all rows with that id are responses.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    thin = pages.select("page_id", "url", payload.alias("p")).select("page_id", "url", F.unhex(F.sha2("p", 256)).alias("address"), base32_sha1(F.col("p")).alias("digest"), F.length("p").cast("long").alias("length"))
    owners = thin.groupBy(F.col("address").alias("a")).agg(F.max("page_id").alias("owner"))
    refers = F.when((F.col("length") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return thin.join(owners, F.col("address") == F.col("a")).select("page_id", "url", "address", "digest", "length", refers.alias("refers_to"))


def header_text():
    """The header block of a record, with its closing empty line. Line ends in urls are escaped."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{URN}"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("length")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads by address; those that a task has met before are left out."""
    met: set[bytes] = set()
    for batch in batches:
        out = []
        for html in batch["html"].to_pylist():
            payload = (html or "").encode()
            address = hashlib.sha256(payload).digest()
            if address not in met:
                met.add(address)
                out.append((address, hashlib.sha1(payload).digest(), len(payload), zlib.compress(payload, 3)))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["address", "sha1", "length", "body"])


def write_archive(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Writes headers and payloads of pages (page_id, url, html) below folder.

    Null html is an empty payload. Equal payloads of at least `least` bytes have one response, that with the largest
    page_id (rows that repeat it are responses as well), and revisits. A null page_id never owns a payload that a
    page with an id has too. An empty table writes empty tables.
    """
    rows = headers(pages, least).withColumn("header", F.encode(header_text(), "UTF-8")).select("address", "header")
    stored(rows, f"{folder}/headers")
    packed = pages.select("html").mapInArrow(pack, "address binary, sha1 binary, length bigint, body binary")
    same = (F.min("sha1") == F.max("sha1")) & (F.min("length") == F.max("length"))
    checked = F.when(same, F.first("body")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")).cast("binary"))
    stored(packed.groupBy("address").agg(checked.alias("body")), f"{folder}/payloads")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(header, body) of every record: the stored header bytes and the compressed payload that they stand for."""
    heads = spark.read.schema("address binary, header binary").parquet(f"{folder}/headers")
    bodies = spark.read.schema("address binary, body binary").parquet(f"{folder}/payloads")
    return heads.join(bodies, "address")


def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses each record and holds its payload against its header."""

    def page(value: bytes | None) -> int | None:
        number = (value or b"").decode().removeprefix(f"<{URN}").removesuffix(">")
        return int(number) if number else None

    for batch in batches:
        out = []
        for header, body in zip(batch["header"].to_pylist(), batch["body"].to_pylist()):
            payload = zlib.decompress(body)
            fields = {k: v for k, v in FIELD.findall(header.replace(b"\r", b""))}
            digest = base64.b32encode(hashlib.sha1(payload).digest())
            kind = fields[b"WARC-Type"]
            if fields[b"WARC-Payload-Digest"] != b"sha1:" + digest or int(fields[b"Content-Length"]) != (len(payload) if kind == b"response" else 0):
                raise ValueError(f"record {fields[b'WARC-Record-ID']!r} does not have the payload that its header names")
            out.append((page(fields[b"WARC-Record-ID"]), len(payload), digest.decode(), kind.decode(), page(fields.get(b"WARC-Refers-To"))))
        columns = list(zip(*out)) or [(), (), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def warc_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(record) with the bytes of a WARC file's records: header, payload of responses, two line ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["header"].to_pylist(), batch["body"].to_pylist())
            made = [h + (b"" if b"\r\nWARC-Type: revisit\r\n" in h else zlib.decompress(b)) + b"\r\n\r\n" for h, b in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    return records(spark, folder).mapInArrow(whole, "record binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from an archive of pages.

    A row each row of pages, repeated ones too; nulls and empty tables as write_archive has them; payloads of any length
    are whole; other columns are left out.
    """
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    write_archive(pages, folder, least)
    return records(spark, folder).mapInArrow(read_records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op9_warc_archive(spark, sf_dir) -> DataFrame:
    """The whole pages table, as archived gives it."""
    return archived(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
  FROM pages)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM p
"""
