"""Content-addressed WARC archive.

An archive is two tables in the shared folder. `payloads` holds each payload's
bytes once, under its SHA-256. `headers` holds, for each record, the exact bytes
before the payload (WARC header and HTTP header) and the payload's address.
Records are rebuilt by joining the two; every payload's digests are checked
against its address and the record's own header when it is read.

The rows that stand for a payload are found by a join of digests with the pages, in
which Spark may send every page's bytes through a shuffle, dealt out by digest and id, so
that a payload that a third of all pages share is no hot key. Rebuilding moves the stored
bytes once more; a query that reads no record or payload is spared that."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import shared_dir, staged

#: Payloads of fewer bytes are written as responses even when they repeat.
REVISIT_BYTES = 1000
_UNFIT = r"[\x00-\x20\x7f]"
_EXACT = "Exact-Target-URI"
_NO_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    headers: str
    payloads: str


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def _header(row: dict[str, Column], date: str) -> Column:
    http = _http(row["length"])
    revisit = row["refers_to"].isNotNull()
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(row["length"])
    uri = F.regexp_replace(row["url"], _UNFIT, "%20")
    # A url that can't stand in a header line, or is empty, goes along in base 64 too.
    exact = F.when((uri != row["url"]) | (row["url"] == ""), F.regexp_replace(F.base64(row["url"].cast("binary")), r"\s", ""))
    own = F.coalesce(row["page_id"].cast("string"), F.concat(F.lit("none:"), F.sha2(F.concat_ws(" ", row["sha256"], F.coalesce(row["url"], F.lit("-"))), 256)))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), own, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line(_EXACT, F.concat(F.lit("base64,"), exact)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), row["sha1"])),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), row["refers_to"].cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )


def write_archive(pages: DataFrame, date: str | None = None) -> Archive:
    """pages(page_id, url, html, ...) -> an archive with one record per row.

    The payload is the html in UTF-8; null is empty. Among rows of equal payload
    of at least REVISIT_BYTES, that with the largest page_id is a response and
    the others revisit it; rows that repeat that page_id too are responses of
    the same stored payload. A null page_id is smaller than any other; the id of its
    record is made of payload and url, so rows that repeat both share it. A null url
    leaves its header line out. date (UTC, such as 2024-01-31T00:00:00Z) is that of
    all records: pages have none of their own; by default the time of this call."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = Archive(f"{base}/headers", f"{base}/payloads")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    full = full.withColumn("k", F.coalesce("page_id", F.lit(_NO_ID))).withColumn("sha256", F.sha2("payload", 256))
    index = full.select("page_id", "k", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"))
    index.write.option("compression", "zstd").parquet(f"{base}/index")
    index = spark.read.schema(index.schema).parquet(f"{base}/index")
    # Written, so that both sides of the join below are plain exchanges, which Spark can split at a frequent address.
    keepers = staged(index.groupBy("sha256").agg(F.max("k").alias("keeper")), "keepers")
    # The bytes: one row for each address.
    stored = full.select("sha256", "k", "payload").join(keepers.withColumnRenamed("keeper", "k"), ["sha256", "k"], "left_semi").dropDuplicates(["sha256", "k"])
    stored.select("sha256", "payload").write.option("compression", "zstd").parquet(made.payloads)
    # The headers: a join on the address of small rows, which Spark can split where one address is frequent.
    rows = index.join(keepers, "sha256")
    refers = F.when((F.col("length") >= REVISIT_BYTES) & (F.col("k") < F.col("keeper")), F.col("keeper"))
    rows = rows.select("page_id", "url", "sha256", "sha1", "length", refers.alias("refers_to"))
    header = _header({c: F.col(c) for c in rows.columns}, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    rows.select(header.cast("binary").alias("header"), "sha256").write.option("compression", "zstd").parquet(made.headers)
    return made


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Records rebuilt from an archive: page_id, url, record_type, refers_to,
    payload, payload_bytes, payload_digest (SHA-1 of the full payload, for
    revisits that of the record they refer to), record (the exact record's bytes).
    A payload that doesn't match its address or its record's digest is an error."""
    payloads = spark.read.schema("sha256 string, payload binary").parquet(archive.payloads)
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), F.col("sha256"))).cast("string"))
    payloads = payloads.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"))
    text = F.col("header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    told = F.unbase64(F.substring(field(_EXACT), len("base64,") + 1, 1 << 30)).cast("string")
    url = F.when(field(_EXACT).isNotNull(), told).otherwise(field("WARC-Target-URI"))
    headers = spark.read.schema("header binary, sha256 string").parquet(archive.headers).select(
        "header", "sha256", number("WARC-Record-ID").alias("page_id"), url.alias("url"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), F.substring(field("WARC-Payload-Digest"), 6, 40).alias("declared")
    )
    both = headers.join(payloads, "sha256")
    digest = F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("record and payload digests differ")).cast("string"))
    tail = F.lit("\r\n\r\n").cast("binary")
    record = F.when(F.col("record_type") == "revisit", F.concat("header", tail)).otherwise(F.concat("header", "payload", tail))
    return both.select("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", digest.alias("payload_digest"), record.alias("record"))
