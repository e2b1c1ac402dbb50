import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import warc
from newsloom.session import scratch_path

ROWS = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, "http://c/x\r\ny", "other\r\n\r\nWARC/1.1"), (4, None, None),
        (5, "http://d/", ""), (9, "http://e/", "x" * 200_000), (None, "http://f/", "<p>é</p>"), (None, "http://g/", "alone"),
        (7, "http://h/", "twice"), (7, "http://h/", "twice")]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows, least=0):
    first, seen, out = {}, set(), []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        source = first.setdefault(raw, page)
        response = len(raw) < least or raw not in seen
        seen.add(raw)
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit",
                    None if response else source))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_summary(spark, least):
    got = warc.summary(warc.records(warc.archived(table(spark, ROWS), least))).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS, least)


def test_records_round_trip(spark):
    archive = warc.archived(table(spark, ROWS))
    assert archive.payloads.count() == len({(h or "") for _, _, h in ROWS})
    records = {}
    for r in warc.records(archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n"
        records.setdefault(fields["WARC-Record-ID"], []).append((fields, rest[:size]))
    assert records["<urn:x-page:2>"][0][1] == ROWS[2][2].encode()
    assert records["<urn:x-page:2>"][0][0]["WARC-Target-URI"] == "http://c/x%0D%0Ay"
    assert records["<urn:x-page:3>"][0][1] == b"" and records["<urn:x-page:3>"][0][0]["WARC-Refers-To"] == "<urn:x-page:1>"
    full = {warc_id: payload for warc_id, payload in warc.pages(archive).select(
        warc.field(F.col("header"), "WARC-Record-ID"), "payload").collect()}
    assert bytes(full["<urn:x-page:3>"]).decode() == "<p>é</p>" and bytes(full["<urn:x-page:4>"]) == b""


def test_damaged_payload_fails(spark):
    path = scratch_path(spark, "damaged")
    warc.write_archive(table(spark, ROWS), path)
    broken = spark.read.parquet(f"{path}/payloads").withColumn(
        "payload", F.when(F.octet_length("payload") == 9, F.lit(b"changed!!")).otherwise(F.col("payload")))
    broken.write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="damaged payload|DAMAGED|USER_RAISED"):
        warc.summary(warc.records(warc.read_archive(spark, f"{path}-2"))).collect()


def test_no_rows(spark):
    assert warc.summary(warc.records(warc.archived(spark.createDataFrame(
        [], "page_id long, url string, html string")))).count() == 0


def test_many_records_of_one_payload(spark):
    rows = [(i, f"http://x/{i}", "same") for i in range(3 * warc.RECORDS_A_COPY)] + [(-1, None, "other")]
    archive = warc.archived(table(spark, rows))
    assert {r.copies for r in archive.payloads.collect()} == {1, 4}
    assert len({r["copy"] for r in archive.headers.collect()}) == 4
    got = warc.summary(warc.records(archive)).collect()
    assert len(got) == len(rows) and sum(r.record_type == "response" for r in got) == 2
