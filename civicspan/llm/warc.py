"""Content-addressed web archive.

An archive is two tables. ``payloads`` holds each distinct payload once, under its SHA-256;
``records`` holds for each page the exact bytes of its WARC and HTTP headers and the digest of
its payload. ``reconstruct`` joins both and returns the original records byte for byte;
``read_records`` reads the fields back from the stored headers and checks them against the stored payloads.

Defined cases: a null html is an empty payload; a null url gives an empty target; of equal
payloads the record with the largest page id is the response and the others revisit it, so rows that
repeat that page id are all responses; a null page id is smaller than all others; payloads smaller
than ``least_bytes`` are always responses; an empty table gives an archive without rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspan.session import fresh_path

LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The digits of base 32 as Spark's ``conv`` writes them, and as RFC 4648 does.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = "page_id long, digest string, header string"
PAYLOAD_SCHEMA = "digest string, payload binary"


@dataclass(frozen=True)
class Archive:
    records: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: five bits a digit, taken from the hexadecimal form forty bits at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _record_id(page: Column) -> Column:
    name = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(name, a, n) for a, n in cuts]), F.lit(">"))


def _header(captured: str) -> Column:
    """The header block of a record: WARC fields, a blank line, and the HTTP header of the capture."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(LINE + LINE),
    )
    revisit = F.col("refers_to").isNotNull()
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{LINE}WARC-Record-ID: "),
        _record_id(F.col("page_id")),
        F.lit(f"{LINE}WARC-Date: {captured}{LINE}WARC-Target-URI: "),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "%0A"),
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{LINE}WARC-Refers-To: "),
                _record_id(F.col("refers_to")),
                F.lit(f"{LINE}WARC-Refers-To-Page: "),
                F.col("refers_to").cast("string"),
                F.lit(f"{LINE}WARC-Profile: {PROFILE}"),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{LINE}Content-Type: application/http; msgtype=response{LINE}Content-Length: "),
        block_bytes.cast("string"),
        F.lit(LINE + LINE),
        http,
    )


def write_archive(pages: DataFrame, captured: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> Archive:
    """Writes both tables to the shared folder.

    Payload bytes are reduced to one a digest before they are shuffled; records travel without them.
    """
    spark = pages.sparkSession
    archive = Archive(fresh_path(spark, "warc-records"), fresh_path(spark, "warc-payloads"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = pages.withColumn("digest", F.sha2("payload", 256))
    payloads = keyed.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(archive.payloads)

    facts = keyed.select(
        "page_id",
        "url",
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    last = facts.groupBy("digest").agg(F.max("page_id").alias("response"))
    is_response = F.col("page_id").eqNullSafe(F.col("response")) | (F.col("payload_bytes") < least_bytes)
    records = facts.join(last, "digest").withColumn("refers_to", F.when(~is_response, F.col("response")))
    records.select("page_id", "digest", _header(captured).alias("header")).write.parquet(archive.records)
    return archive


def _tables(spark: SparkSession, archive: Archive) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(RECORD_SCHEMA).parquet(archive.records),
        spark.read.schema(PAYLOAD_SCHEMA).parquet(archive.payloads),
    )


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """Each record's exact bytes (a revisit has no payload of its own), and its full payload."""
    records, payloads = _tables(spark, archive)
    joined = records.join(payloads, "digest")
    own = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    block = F.concat(F.col("header").cast("binary"), own, F.lit((LINE + LINE).encode()))
    return joined.select("page_id", block.alias("record"), "payload")


def field(name: str) -> Column:
    """A WARC field of a stored header, null if it is absent."""
    value = F.regexp_extract("header", f"(?m)^{name}: ([^\\r\\n]*)\\r?$", 1)
    return F.when(value != "", value)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Page, payload size and digest, record type and reference of each record in an archive.

    Size and digests are computed anew from the stored payloads, once for each, before the join.
    A payload whose SHA-256 isn't its address, or a header that names another digest, stops the job.
    """
    records, payloads = _tables(spark, archive)
    read = payloads.select(
        "digest",
        (F.sha2("payload", 256) == F.col("digest")).alias("sound"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    sound = F.col("sound") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    return records.join(read, "digest").select(
        "page_id",
        "payload_bytes",
        F.when(sound, F.col("payload_digest"))
        .otherwise(F.raise_error(F.lit("a payload differs from its digest")))
        .alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
    )
