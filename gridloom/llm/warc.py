"""A content-addressed WARC archive.

An archive is a folder of two Parquet tables. ``payloads`` holds each distinct payload once, under its SHA-256;
``headers`` holds the exact header block of every record, its type and the digest of its payload. Records are put together again by a join,
and every payload is checked against its digest as it is read. Equal payloads are written once as a ``response`` record,
that of the largest id; the others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled, scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def base32(hexed: Column) -> Column:
    """Hex digits, a multiple of five of them as in SHA-1, as base32 of the same bits."""

    def four(i: Column) -> Column:
        v = F.conv(F.substr(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` to a new archive at ``path``.

    Null bodies are empty payloads; null addresses leave the record without a target; null ids sort below all others.
    Rows that repeat id and payload are records of the same type. Payloads of fewer than ``min_bytes`` bytes are never
    revisited. Ids are numbers; others stop the job. Columns other than the three named are not looked at.
    """
    spark = pages.sparkSession
    body = filled(body_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    rows.groupBy("digest", "payload").agg(F.max("id").alias("first_id")).write.parquet(f"{path}/payloads")
    stored = spark.read.schema("digest string, first_id bigint").parquet(f"{path}/payloads")
    if not stored.groupBy("digest").count().where("count > 1").isEmpty():
        raise ValueError("two payloads share a SHA-256 digest")
    light = rows.select("id", "url", "digest", F.octet_length("payload").alias("bytes"), base32(F.sha1("payload")).alias("sha1"))
    joined = light.join(stored, "digest").withColumn("first", F.col("id").eqNullSafe(F.col("first_id")) | (F.col("bytes") < min_bytes))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("first"), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("first"), "").otherwise(F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.col("first_id").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(REVISIT)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(F.col("first"), F.col("bytes")).otherwise(0) + len(HTTP)).cast("string")),
    )
    joined.select("id", "digest", F.when(F.col("first"), "response").otherwise("revisit").alias("kind"), header.alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: id, header, record (its bytes as a WARC file holds them), payload (the full one, for revisits too), its length and SHA-1.

    Length and SHA-1 are taken of the stored payload, once however many records have it. A payload that is not what its digest says stops the job.
    """
    headers = spark.read.schema("id bigint, digest string, kind string, header string").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    right = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("binary"))
    stored = stored.select("digest", right.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    joined = headers.join(stored, "digest")
    block = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    record = F.concat(F.concat(F.col("header"), F.lit(f"\r\n{HTTP}")).cast("binary"), block, F.lit(END).cast("binary"))
    return joined.select("id", "header", record.alias("record"), "payload", "payload_bytes", "payload_digest")


def write_files(records: DataFrame, path: str, compression: str = "none") -> None:
    """The records' bytes one after the other in files of a new folder, as other readers of WARC take them.

    Bodies come from text and are UTF-8, so a record is text too; the line ends after it are what parts the lines of the sink.
    """
    text = F.col("record").cast("string")
    records.select(F.substr(text, F.lit(1), F.char_length(text) - len(END)).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, ours or others': id (null if not ours), header, record, payload (the body, which revisits lack).

    A file is read whole by one task. Lengths are taken from the headers; a file that ends within a record stops the job. Header bytes that are
    no UTF-8 are replaced in ``header``; ``record`` has them as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                content = raw.as_buffer().to_pybytes()
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                at = 0
                while at < len(content):
                    head = content.find(END.encode(), at)
                    length = re.search(rb"\r\nContent-Length: *([0-9]+)", content[at : max(at, head) + 2], re.I)
                    if head < 0 or not length or head + 4 + int(length[1]) > len(content):
                        raise ValueError("a file ends within a record")
                    end = head + 4 + int(length[1])
                    own = re.search(rb"\r\nWARC-Record-ID: <urn:x-page:(-?[0-9]+)>", content[at:head])
                    body = content[head + 4 : end]
                    if re.search(rb"\r\nContent-Type: *application/http\b", content[at:head], re.I):
                        body = body.partition(END.encode())[2]
                    columns = [pa.array([own and int(own[1])], pa.int64()), pa.array([content[at : head + 2].decode(errors="replace")]), pa.array([content[at : end + 4]], pa.binary()), pa.array([body], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "header", "record", "payload"])
                    at = end + 4

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, header string, record binary, payload binary")


def parsed(records: DataFrame) -> DataFrame:
    """The fields of records as read from their bytes: record_type, record_id, refers_to, target, digest, content_length."""
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    field = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    page = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: <urn:x-page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    return records.withColumn("head", head).select(
        page("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target"),
        F.regexp_extract("head", "\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("digest"), field("Content-Length").cast("long").alias("content_length"), "record", "payload", "payload_bytes", "payload_digest",
    )


def warc_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive, read it back, and report each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, min_bytes=min_bytes)
    return parsed(read_archive(spark, path)).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
