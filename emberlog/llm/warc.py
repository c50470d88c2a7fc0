"""Content-addressed WARC archive: payload bytes once per digest, exact record headers beside them.

Two tables make an archive: ``payloads`` (SHA-256, bytes in a zstd frame), one row per distinct payload, and
``headers`` (the exact header block of each record and the SHA-256 it refers to). A record is the header block followed, for a response,
by the payload; revisits carry no payload. Reading joins the two and checks both digests again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import forget_at_exit, stage
from emberlog.session import shared_dir

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
# Digits of Spark's conv() in base 32 and those of RFC 4648.
BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of the bytes as 32 base-32 digits: four times ten hex digits become eight."""
    hexed = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.concat(*parts), BASE_32, RFC_4648)


def page_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _header(record_type: str, payload_length: Column) -> Column:
    """The header block of a record, up to and with its empty line."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {record_type}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_text("page_id"), F.lit(":"), F.col("copy"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.col("sha256")),
    ]
    if record_type == "revisit":
        lines += [
            F.concat(F.lit("WARC-Refers-To: <urn:page:"), page_text("response_id"), F.lit(":1>")),
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}"),
        ]
    lines += [F.lit("Content-Type: text/html;charset=utf-8"), F.concat(F.lit("Content-Length: "), payload_length)]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END))


def write_archive(pages: DataFrame, where: str, least_bytes: int = 0) -> None:
    """Write the records of ``pages`` (page_id, url, html) to ``where``/payloads and ``where``/headers.

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of at least
    ``least_bytes`` bytes the one with the largest page_id is the response; all smaller ones are responses
    themselves. Rows that repeat a page_id with the same payload are copies: the first is the response, the rest
    revisit it. A null page_id sorts below all others. Further columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    known = stage(
        pages.select(
            "page_id",
            "url",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("sha256"),
            base32_sha1(F.col("payload")).alias("sha1"),
        )
    )
    # equal SHA-256 with unequal SHA-1 or length would be a collision: such rows never share a payload
    same = ["sha256", "sha1", "payload_bytes"]
    first = known.groupBy(*same).agg(F.max("page_id").alias("response_id"))
    copy = F.row_number().over(Window.partitionBy("page_id", *same).orderBy("url"))
    records = (
        known.withColumn("url", F.coalesce("url", F.lit("")))
        .withColumn("copy", copy)
        .join(first, same)
        .withColumn("own", (F.col("copy") == 1) & F.col("page_id").eqNullSafe(F.col("response_id")))
    )
    revisit = ~F.col("own") & (F.col("payload_bytes") >= least_bytes)
    header = F.when(revisit, _header("revisit", F.lit("0"))).otherwise(
        _header("response", F.col("payload_bytes").cast("string"))
    )
    records.select(header.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{where}/headers")
    keepers = first.select(F.col("response_id").alias("keeper"), F.col("sha256").alias("keeper_sha"))
    payloads = (
        pages.select("page_id", F.sha2("payload", 256).alias("sha256"), "payload")
        .mapInArrow(_compress, "page_id long, sha256 string, packed binary")
        .join(keepers, F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("sha256") == F.col("keeper_sha")))
        .dropDuplicates(["page_id", "sha256"])
    )
    payloads.select("sha256", "packed").write.option("compression", "none").parquet(f"{where}/payloads")


def read_headers(spark: SparkSession, where: str) -> DataFrame:
    """The record headers of an archive, parsed: page_id, copy, record_type, refers_to, digests, content length."""

    def field(name: str, pattern: str) -> Column:
        # lines end at CR LF only: a URL may hold separators that a matcher takes for line ends unless told otherwise
        found = F.regexp_extract("header", f"(?md)^{name}: {pattern}\\r?$", 1)
        return F.when(found != "", found)

    return spark.read.parquet(f"{where}/headers").select(
        "header",
        "sha256",
        field("WARC-Record-ID", "<urn:page:(-?\\d+):\\d+>").cast("long").alias("page_id"),
        field("WARC-Record-ID", "<urn:page:-?\\d*:(\\d+)>").cast("int").alias("copy"),
        field("WARC-Type", "(\\w+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?\\d+):1>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("payload_digest"),
        field("Content-Length", "(\\d+)").cast("long").alias("content_length"),
    )


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload in a frame of its own, so that less is shuffled and any record can be read alone."""
    packer = zstandard.ZstdCompressor(level=5)
    for batch in batches:
        packed = [packer.compress(p.as_buffer()) for p in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["page_id", "sha256", "packed"]
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload = unpacker.decompress(packed.as_buffer())
            if hashlib.sha256(payload).hexdigest() != key:
                raise ValueError(f"damaged payload {key}")
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            columns = [pa.array([x]) for x in (key, sha1, len(payload), payload)]
            yield pa.RecordBatch.from_arrays(columns, ["sha256", "stored_sha1", "payload_bytes", "payload"])


def verified_payloads(spark: SparkSession, where: str, keep_bytes: bool = True) -> DataFrame:
    """Stored payloads with their digests computed anew; a payload that is not what its key says stops the job."""
    schema = "sha256 string, stored_sha1 string, payload_bytes long, payload binary"
    if not keep_bytes:
        return spark.read.parquet(f"{where}/payloads").mapInArrow(_facts_only, schema.rpartition(",")[0])
    return spark.read.parquet(f"{where}/payloads").mapInArrow(_verify, schema)


def _facts_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_verify` without the payloads themselves, in batches as they came."""
    for batch in batches:
        rows = [one.select(["sha256", "stored_sha1", "payload_bytes"]) for one in _verify(iter([batch]))]
        if rows:
            yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def read_records(spark: SparkSession, where: str) -> DataFrame:
    """The original records byte for byte: header block, payload of a response, and the end of the record."""
    heads = read_headers(spark, where)
    bodies = verified_payloads(spark, where).select("sha256", "payload", "payload_bytes")
    is_response = F.col("record_type") == "response"
    return heads.join(bodies, "sha256").select(
        "page_id",
        "record_type",
        "refers_to",
        "payload_digest",
        "payload_bytes",
        "payload",
        F.concat(
            F.col("header").cast("binary"),
            F.when(is_response, F.col("payload")).otherwise(F.lit(b"")),
            F.lit(RECORD_END.encode()),
        ).alias("record"),
    )


def export_warc(spark: SparkSession, where: str, target: str) -> None:
    """Write the records as plain ``.warc`` text files: the line end of each record is its closing CRLF CRLF."""
    heads = read_headers(spark, where)
    bodies = verified_payloads(spark, where).select("sha256", "payload")
    body = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    heads.join(bodies, "sha256").select(F.concat("header", body).alias("value")).write.option(
        "lineSep", RECORD_END
    ).text(target)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write an archive of ``pages``, read it back and return one row per record, that is per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, all taken from the archive. Every
    payload's digests are computed anew, and header and payload must agree. No rows in: no rows out.
    """
    spark = pages.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, where, least_bytes)
    forget_at_exit(spark, where)
    bodies = verified_payloads(spark, where, keep_bytes=False)
    agree = (F.col("payload_digest") == F.col("stored_sha1")) & (
        F.col("content_length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    )
    return (
        read_headers(spark, where)
        .join(bodies, "sha256")
        .select(
            "page_id",
            "payload_bytes",
            F.when(agree, F.col("payload_digest"))
            .otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("sha256"))))
            .alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
