"""A content-addressed web archive.

A payload is stored once, under its SHA-256; record headers are stored apart, byte by
byte as they stand in a WARC file, and refer to it. Records are rebuilt by joining the
two. Reading recomputes every payload's digests and stops on a mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: every 5 hex digits are 4 digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes (page_id, url, html) as ``path/headers`` and ``path/payloads``.

    A null html is an empty payload, a null url an empty one; line breaks and spaces in
    a url are percent-encoded. Of the records with equal payloads of at least ``least``
    bytes the one with the smallest page_id is a response and others are revisits;
    rows that repeat that page_id are responses too. Shorter payloads are all responses.
    Payloads are grouped before they are shuffled, so a page with many copies travels
    once for each task that reads it.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.coalesce(F.col("url"), F.lit(""))
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    hashed = pages.select("page_id", url.alias("url"), payload.alias("payload")).withColumn("content", F.sha2("payload", 256))
    hashed.groupBy("content").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    narrow = hashed.select("page_id", "url", "content", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    firsts = narrow.groupBy("content").agg(F.min("page_id").alias("first_id"))
    revisits = (F.col("length") >= least) & (F.col("page_id") > F.col("first_id"))
    named = lambda name: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(name).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("length").cast("string"), F.lit(CRLF * 2))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", named("page_id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", named("first_id")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("length"))).cast("string")),
        F.lit(CRLF),
    )
    records = narrow.join(firsts, "content").withColumn("revisit", F.coalesce(revisits, F.lit(False))).withColumn("http", http)
    records.select("content", head.alias("warc_header"), F.col("http").alias("http_header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(content, payload, payload_bytes, payload_digest), each payload checked against its address."""
    found = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("content")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    found = found.select("content", checked.alias("payload"))
    return found.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its fields parsed from the stored header.

    ``record`` holds the record's bytes as in a WARC file (revisits carry no payload);
    ``payload`` is that of the page, for revisits too.
    """
    field = lambda name: F.regexp_extract("warc_header", f"\n{name}: ([^\r\n]*)", 1)
    page = lambda name: F.expr(f"try_cast(regexp_extract({name}, '<urn:x-page:(-?[0-9]+)>', 1) as long)")
    records = spark.read.parquet(f"{path}/headers").join(read_payloads(spark, path), "content")
    records = records.withColumns({"record_type": field("WARC-Type"), "id_field": field("WARC-Record-ID"), "refers_field": field("WARC-Refers-To"), "target_uri": field("WARC-Target-URI"), "header_digest": field("WARC-Payload-Digest")})
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(
        page("id_field").alias("page_id"), "target_uri", "record_type", page("refers_field").alias("refers_to"),
        "payload", "payload_bytes", "payload_digest", "header_digest",
        F.concat(F.encode("warc_header", "UTF-8"), F.encode("http_header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )
