"""Content-addressed web archive.

write_archive() keeps two tables in a folder: ``payloads``, each distinct payload once under its SHA-256,
and ``headers``, the exact header block of every record with the digest of its payload. records() joins
them again into the original WARC/1.1 records; read_archive() parses the header blocks, recomputes the
digests of the stored payloads and returns one row per record.

Defined results: a null payload counts as empty; a null key is written without a URI suffix and is never
the record that others refer to (a group of null keys alone is all ``response``); rows that repeat the
largest key of a group are all ``response``; an empty table gives an empty archive; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch, table

#: Payloads of at least so many bytes can be revisited.
MIN_REVISIT = 1000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", uri: str = "url", min_revisit: int = MIN_REVISIT) -> None:
    """Writes a record for every row: payload bytes once per SHA-256, headers apart."""
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("body"))
    rows = rows.select("k", "uri", "body", F.sha2("body", 256).alias("address"))
    # first(): payloads under one address are equal; the two sums of the group fail the job if they are not.
    held = rows.groupBy("address").agg(F.first("body").alias("body"), F.min(F.crc32("body")).alias("low"), F.max(F.crc32("body")).alias("high"), F.min(F.octet_length("body")).alias("short"), F.max(F.octet_length("body")).alias("long"))
    clash = F.when((F.col("low") != F.col("high")) | (F.col("short") != F.col("long")), F.raise_error(F.lit("two payloads have one digest")).cast("binary")).otherwise(F.col("body"))
    held.select("address", clash.alias("body")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")

    named = rows.select("k", "uri", "address", F.octet_length("body").cast("bigint").alias("size"), F.sha1("body").alias("sha1"))
    first = named.groupBy("address").agg(F.max("k").alias("keeper"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("keeper").isNotNull()).select("address", "keeper")
    named = named.join(first, "address", "left")
    revisit = (F.col("size") >= min_revisit) & F.col("keeper").isNotNull() & ((F.col("k") < F.col("keeper")) | F.col("k").isNull())
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", record_id(F.col("k"))),
        _line("WARC-Date", F.lit(DATE)),
        # a line break in a URI would end the header line
        _line("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]", "%0A")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("kind") == "revisit", F.concat(_line("WARC-Refers-To", record_id(F.col("keeper"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html;charset=utf-8")),
        _line("Content-Length", F.col("size").cast("string")),
        F.lit(CRLF),
    )
    named.withColumn("kind", kind).select("address", block.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records as bytes: header block, payload, two line ends. Revisits carry their payload too."""
    headers, payloads = (spark.read.parquet(f"{path}/{x}") for x in ("headers", "payloads"))
    return headers.join(payloads, "address").select("address", F.concat(F.encode("header", "UTF-8"), F.col("body"), F.lit(b"\r\n\r\n")).alias("record"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the parsed header and the stored payload.

    The digests are those of the payload bytes as read; a payload that doesn't match its address, its
    length or the digest in a header raises an error. Digests are made before the join, so only they
    and not the payloads are shuffled.
    """
    headers, payloads = (spark.read.parquet(f"{path}/{x}") for x in ("headers", "payloads"))
    bad = F.sha2("body", 256) != F.col("address")
    verified = payloads.select(F.when(bad, F.raise_error(F.lit("a stored payload is damaged")).cast("string")).otherwise(F.col("address")).alias("address"), F.octet_length("body").cast("bigint").alias("payload_bytes"), F.sha1("body").alias("payload_digest"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("bigint")
    parsed = headers.select("address", number(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Target-URI").alias("uri"), _field("WARC-Type").alias("record_type"), number(_field("WARC-Refers-To")).alias("refers_to"), _field("WARC-Payload-Digest").alias("told"), _field("Content-Length").cast("bigint").alias("length"))
    whole = parsed.join(verified, "address")
    bad = (F.col("told") != F.concat(F.lit("sha1:"), F.col("payload_digest"))) | (F.col("length") != F.col("payload_bytes"))
    digest = F.when(bad, F.raise_error(F.lit("a header doesn't fit its payload")).cast("string")).otherwise(F.col("payload_digest"))
    return whole.select("page_id", "uri", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).drop("uri")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d),
     r AS (SELECT *, payload_bytes >= {MIN_REVISIT} AND keeper IS NOT NULL AND (page_id < keeper OR page_id IS NULL) AS again FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to
FROM r
"""
