"""A content-addressed WARC archive in two tables of the shared folder.

``payloads`` holds every distinct payload once, under its SHA-256. ``records``
holds one row per record: the exact header block of its WARC/1.1 record and
the address of its payload. A record is rebuilt by a join of the two; each
payload is checked against its address when read.

Of the records whose payloads are equal and have ``revisit_from`` bytes or
more, the one with the largest id is the response and the others are revisits
that refer to it; smaller payloads are always responses.

A response's block is an HTTP message: its status line and headers are part of
the kept header, the payload follows. A record's id is made of the row's id and
the payload's address, so a revisit can name the response it refers to.

A hot payload is combined on the map side before it is shuffled, so it travels
once per task, and headers join on 32-byte addresses, never on payloads. When
records are written, a hot address is split by Spark's skew join; when they are
read, its payload is repeated once for every ``COPIES_PER_SALT`` records and each
record meets one of them, as its stored salt says.

Defined results: null html is the empty payload; ids may be numbers or text and
come back as they were; null ids are kept and count as the smallest; rows that
repeat the largest id of their group are all responses, with one record id.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_path

RECORD_ID = "urn:millrace:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
COPIES_PER_SALT = 10_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables are."""

    path: str
    id_type: str = "bigint"

    def payloads(self, spark: SparkSession) -> DataFrame:
        """(address, copies, payload, payload_bytes, payload_sha1): every distinct payload, verified against its address."""
        stored = spark.read.schema("address binary, copies long, payload binary").parquet(f"{self.path}/payloads")
        true = F.unhex(F.sha2("payload", 256))
        checked = F.when(true == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.hex("address"))).cast("binary"))
        return stored.select("address", "copies", checked.alias("payload")).select("address", "copies", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"))

    def headers(self, spark: SparkSession) -> DataFrame:
        """(header, address, salt): one row per record."""
        return spark.read.schema("header binary, address binary, salt int").parquet(f"{self.path}/records")


def header_field(header: Column, name: str) -> Column:
    """A field of a header block, null if absent."""
    found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(header.contains(f"\r\n{name}: "), found)


def _line_safe(value: Column) -> Column:
    """A value that can't break a header: control characters as percent codes."""
    out = F.coalesce(value, F.lit("")).cast("string")
    return F.when(out.rlike(r"[\x00-\x20\x7f]"), F.replace(F.url_encode(out), F.lit("+"), F.lit("%20"))).otherwise(out)


def _salts(copies: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(copies / COPIES_PER_SALT)).cast("int")


def _name(own_id: Column) -> Column:
    """An id in a record id: "i" and the encoded id, "-" for null."""
    return F.coalesce(F.concat(F.lit("i"), F.replace(F.url_encode(own_id.cast("string")), F.lit("+"), F.lit("%20"))), F.lit("-"))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, date: str | None = None) -> Archive:
    """Write one record per row of ``pages``; ``date`` is the WARC-Date of all, this moment if None."""
    spark = pages.sparkSession
    archive = Archive(new_path(spark, "warc"), dict(pages.dtypes)[id_col])
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.unhex(F.sha2("payload", 256)))
    rows.groupBy("address").agg(F.count(F.lit(1)).alias("copies"), F.any_value("payload").alias("payload")).write.parquet(f"{archive.path}/payloads")

    records = rows.select("id", "url", "address", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    newest = F.max(F.struct("id", "url"))
    first = records.groupBy(F.col("address").alias("of")).agg(newest.alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = records.join(first, F.col("address") == F.col("of"), "left")
    revisit = (F.col("n") >= revisit_from) & F.col("copies").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")["id"])

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def record_id(own_id: Column) -> Column:
        return F.concat(F.lit(f"<{RECORD_ID}"), _name(own_id), F.lit(":"), F.lower(F.hex("address")), F.lit(">"))

    http = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _line_safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", record_id(F.col("response")["id"])), line("WARC-Refers-To-Target-URI", _line_safe(F.col("response")["url"])),
            line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    salt = F.pmod(F.xxhash64("id", "url"), _salts(F.coalesce("copies", F.lit(1)))).cast("int")
    joined.select(header.cast("binary").alias("header"), "address", salt.alias("salt")).write.parquet(f"{archive.path}/records")
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The archive read back: per record its id, url, type, refers_to, header, the full payload with its size and SHA-1,
    and ``record``, the original record's bytes (a revisit's has no payload).

    Columns that are not selected are not computed: without ``payload`` and ``record`` no payload is shuffled.
    """
    text = F.col("header").cast("string")
    payloads = archive.payloads(spark).withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("copies")) - 1)))
    joined = archive.headers(spark).join(payloads, ["address", "salt"])
    kind = header_field(text, "WARC-Type")
    record = F.concat("header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n"))

    def id_in(field: str) -> Column:
        named = F.regexp_extract(text, rf"(?m)^{field}: <{RECORD_ID}i([^:>]*):", 1)
        return F.when(text.rlike(rf"(?m)^{field}: <{RECORD_ID}i"), F.url_decode(named)).cast(archive.id_type)

    return joined.select(
        id_in("WARC-Record-ID").alias("id"),
        header_field(text, "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        id_in("WARC-Refers-To").alias("refers_to"),
        header_field(text, "WARC-Payload-Digest").alias("header_digest"),
        "header", "payload_bytes", "payload_sha1", "payload", record.alias("record"),
    )
