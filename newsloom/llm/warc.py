"""Content-addressed web archive.

``payloads`` holds the bytes of each distinct payload once under its SHA-256, ``headers`` the exact
header block of every record.  A record is put together again by joining the two.  When the
archive is read, every payload is hashed again, and one that doesn't fit its address fails the read.
The headers of a payload that many records share are dealt over copies of it, so that no task puts
all of them together.

Cases with a defined result: a null payload counts as empty; of records with equal payloads the one
with the smallest page_id is the response, null ids come last, and of rows repeated whole one is
the response; line breaks and control characters of a url are percent-encoded, a null url is empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed values of the archive format and of base32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"


RECORDS_A_COPY = 256  # of a payload that many records share


class Archive(NamedTuple):
    payloads: DataFrame  # digest, payload, copies
    headers: DataFrame  # header, digest, copy


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight stretches of 20 bits, four characters each."""
    parts = []
    for stretch in range(8):
        bits = F.conv(F.substring(F.sha1(value), 5 * stretch + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(31) + 1
            parts.append(F.lit(BASE32).substr(place, F.lit(1)))
    return F.concat(*parts)


def _record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _page_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def _url(url: Column) -> Column:
    clean = F.coalesce(url, F.lit(""))
    for code in (*range(32), 127):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), clean).otherwise(F.coalesce(url, F.lit("")))


def field(header: Column, name: str) -> Column:
    """Value of a header line; null without it."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``: one record each.

    Equal payloads of at least ``revisit_from`` bytes are stored once anyway, and all records but
    the first are revisits of it; records with smaller payloads are all responses.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), _url(F.col("url")).alias("url"),
                          payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    # copies meet in their map task first; what is shuffled is at most one payload per task and digest
    (hashed.groupBy("digest").agg(
        F.any_value("payload").alias("payload"), F.count("*").alias("n_records"),
        F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id")).alias("first"))
     .select("digest", "payload", (F.floor(F.col("n_records") / RECORDS_A_COPY) + 1).cast("int").alias("copies"),
             F.col("first.page_id").alias("first_page"), F.octet_length("payload").cast("long").alias("n"),
             base32_sha1(F.col("payload")).alias("sha1"))
     .write.parquet(f"{path}/payloads"))
    known = spark.read.parquet(f"{path}/payloads").select("digest", "first_page", "n", "sha1", "copies")
    records = hashed.select("page_id", "url", "digest").join(known, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first_page"))
    alike = Window.partitionBy("digest", "page_id").orderBy(F.lit(1))  # rows repeated whole
    response = (F.col("n") < revisit_from) | (is_first & (F.row_number().over(alike) == 1))
    records = records.withColumn("response", response)

    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(BREAK))

    common = [line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))]
    as_response = F.concat(
        F.lit(VERSION + BREAK), line("WARC-Type", "response"), line("WARC-Record-ID", _record_name(F.col("page_id"))),
        *common, line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", F.col("n").cast("string")))
    as_revisit = F.concat(
        F.lit(VERSION + BREAK), line("WARC-Type", "revisit"), line("WARC-Record-ID", _record_name(F.col("page_id"))),
        *common, line("WARC-Profile", REVISIT_PROFILE), line("WARC-Refers-To", _record_name(F.col("first_page"))),
        line("Content-Length", "0"))
    (records.select(F.when(F.col("response"), as_response).otherwise(as_revisit).alias("header"), "digest",
                    F.pmod(F.xxhash64("page_id", "url"), "copies").cast("int").alias("copy"))
     .write.parquet(f"{path}/headers"))


def read_archive(spark: SparkSession, path: str) -> Archive:
    """The stored tables; a payload whose bytes don't fit its digest fails the read."""
    payloads = spark.read.schema("digest binary, payload binary, copies int").parquet(f"{path}/payloads")
    fits = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = payloads.withColumn("payload", F.when(fits, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))).cast("binary")))
    return Archive(checked, spark.read.schema("header string, digest binary, copy int").parquet(f"{path}/headers"))


def records(archive: Archive) -> DataFrame:
    """(header, record, payload): each record's bytes as an archive file has them, and what it stands for.

    ``record`` is the header block, an empty line, the content and two line breaks; a revisit has no
    content, and its payload is that of the record it refers to.
    """
    dealt = archive.payloads.select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "payload")
    joined = archive.headers.join(dealt, ["digest", "copy"])
    content = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(BREAK).cast("binary")
    return joined.select("header", F.concat(F.col("header").cast("binary"), end, content, end, end).alias("record"), "payload")


def pages(archive: Archive) -> DataFrame:
    """(header, payload) of every record, the full payload for revisits too."""
    return records(archive).select("header", "payload")


def summary(rebuilt: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records as :func:`records` gives them.

    The header block is cut out of the record's own bytes; a length or digest that it claims and that
    the content or the payload doesn't have fails the read.
    """
    mark = BREAK + BREAK
    size = F.octet_length(F.col("header").cast("binary"))
    own = F.col("record").substr(F.lit(1), size).cast("string")
    n_content = F.octet_length("record") - size - F.lit(len(BREAK) + len(mark))
    named = rebuilt.select(own.alias("own"), n_content.alias("n_content"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                           base32_sha1(F.col("payload")).alias("payload_digest"))
    header = F.col("own")
    claimed = F.substring_index(field(header, "WARC-Payload-Digest"), ":", -1)
    fits = (claimed == F.col("payload_digest")) & (field(header, "Content-Length").cast("long") == F.col("n_content"))
    return named.select(
        _page_of(field(header, "WARC-Record-ID")).alias("page_id"), "payload_bytes",
        F.when(fits, F.col("payload_digest")).otherwise(
            F.raise_error(F.concat(F.lit("header and record differ: "), header))).alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"),
        _page_of(field(header, "WARC-Refers-To")).alias("refers_to"))


def archived(page_rows: DataFrame, revisit_from: int = 0) -> Archive:
    """Write the pages to a fresh archive in the shared folder and open it."""
    spark = page_rows.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(page_rows, path, revisit_from)
    return read_archive(spark, path)
