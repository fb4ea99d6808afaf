"""Content-addressed WARC archive.

An archive is two tables below one path.  ``payloads`` has every distinct payload once, under its SHA-256, which readers
verify against the bytes.  ``headers`` has the exact header block of every record, and the SHA-256 of its payload.  A
record is put together again by a join of the two.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the response; the others
are revisits that refer to it, and have no payload in their block.  Smaller payloads are all responses; they too are
stored once.

Copies are reduced before payloads are shuffled, and what refers to a payload is joined without its bytes.

Defined results: a null payload is an empty one; of rows with equal payload and id one is the response; null ids come
last; a null target gives no target field, and line ends in one are percent-encoded; an empty table makes an empty
archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# Fields and profile of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"  # of the records, unless the caller names one


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1; five hex digits make four of its characters."""
    digits = F.sha1(data)
    groups = (F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8))
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(digest: Column) -> Column:
    """Record id from 32 hex digits."""
    parts = (F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def header_field(header: Column, name: str) -> Column:
    """Value of a header field, null without one."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def write_archive(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    target_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = DATE,
) -> None:
    """Write a record for each row of ``df`` to a new archive at ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    target = F.col(target_col).cast("string")
    target = F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = df.select(F.col(id_col).alias("id"), target.alias("target"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")

    size = F.octet_length("payload").cast("bigint").alias("n")
    index = rows.select("id", "target", "sha256", size, base32_sha1(F.col("payload")).alias("sha1"))
    number = F.monotonically_increasing_id()
    index = cut_lineage(
        index.withColumn("number", number).withColumn(
            "record_id", urn(F.md5(F.concat_ws("|", "id", "target", F.hex("sha256"), F.col("number"))))
        )
    )
    order = F.struct(F.col("id").isNull().alias("last"), "id", "number", "record_id", "target")
    first = cut_lineage(index.groupBy("sha256").agg(F.min(order).alias("first")))
    is_revisit = (F.col("n") >= min_bytes) & (F.col("number") != F.col("first.number"))
    header = F.concat(
        F.lit(VERSION + CRLF),
        field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("target")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        field("WARC-Profile", F.when(is_revisit, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.when(is_revisit, F.col("first.record_id"))),
        field("WARC-Refers-To-Target-URI", F.when(is_revisit, F.col("first.target"))),
        field("Source-Row", F.col("id")),
        field("Refers-To-Source-Row", F.when(is_revisit, F.col("first.id"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(is_revisit, F.lit(0)).otherwise(F.col("n"))),
        F.lit(CRLF),
    )
    index.join(first, "sha256").select("sha256", header.alias("header")).write.parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``sha256``, ``header`` and the fields that name record, type and reference; no payload is touched."""
    header = F.col("header")
    return spark.read.parquet(f"{path}/headers").select(
        "sha256",
        "header",
        header_field(header, "Source-Row").alias("id"),
        header_field(header, "WARC-Type").alias("record_type"),
        header_field(header, "WARC-Payload-Digest").alias("payload_digest"),
        header_field(header, "Refers-To-Source-Row").alias("refers_to"),
    )


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``sha256`` and ``payload``; a payload that is not what its digest says fails the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return stored.select("sha256", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("damaged payload"))).alias("payload"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Records with size and SHA-1 of their whole payload, both taken from the stored bytes before the join."""
    facts = verified_payloads(spark, path).select(
        "sha256",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("stored_digest"),
    )
    joined = read_headers(spark, path).join(cut_lineage(facts), "sha256")
    sound = F.col("payload_digest") == F.concat(F.lit("sha1:"), F.col("stored_digest"))
    digest = F.when(sound, F.col("stored_digest")).otherwise(F.raise_error(F.lit("header and payload differ")))
    return joined.select("id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Columns of ``read_headers``, ``payload`` (of the record itself or of what it revisits) and ``record``, its bytes."""
    joined = read_headers(spark, path).join(verified_payloads(spark, path), "sha256")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), block, F.lit(CRLF * 2).cast("binary"))
    return joined.withColumn("record", record)
