import gzip
import hashlib

import pytest

from panelflow.llm import warc
from panelflow.llm.common import shared_dir

PAGES = "page_id long, url string, html string, digest string, first long"


def test_records_come_back(spark):
    long = "<p>äö漢</p>" * 30_000
    rows = [(1, "http://a/x y\n", "b" * 1000, "d", 1), (7, None, "b" * 1000, None, None), (7, "u", "b" * 1000, "d", 2), (3, "u", long, "d", 3), (2, "u", long, "d", 3), (4, "u", None, "d", 4), (5, "u", "", "d", 5), (6, "u", "c" * 999, "d", 6), (8, "u", "c" * 999, "d", 6), (None, "u", "b" * 1000, "d", 7), (None, "u", "z" * 2000, "d", 7)]
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect())
    first = {"b" * 1000: 7, long: 3}
    want = []
    for page, _, html, _, _ in rows:
        data = (html or "").encode()
        leads = first.get(html)
        revisit = leads is not None and page != leads
        want.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", leads if revisit else None))
    assert got == sorted(want)


def test_archive_is_plain_warc(spark):
    folder = shared_dir(spark)
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200_000, None, None)], PAGES)
    chunks = warc.chunk_table(pages)
    assert [r["n"] for r in chunks.selectExpr("octet_length(chunk) n").collect()] == [65536, 65536, 65536, 3392]
    places = warc.written(warc.write_responses(chunks, folder), folder, "places")
    (row,) = warc.write_archives(warc.decided(places, folder), folder).collect()
    text = gzip.open(row["path"].removeprefix("file:")).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>") and text.endswith(b"x\r\n\r\n")
    head, http, body = text.split(b"\r\n\r\n", 2)
    assert int(head.rpartition(b"Content-Length: ")[2]) == len(http) + 4 + 200_000


def test_a_damaged_payload_is_found(spark):
    folder = shared_dir(spark)
    bad = warc.chunk_table(spark.createDataFrame([(1, "u", "x" * 70_000, None, None)], PAGES)).withColumn("chunk", warc.F.lit(b"y"))
    with pytest.raises(Exception, match="digest"):
        warc.write_responses(bad, folder).collect()


def test_no_payload_is_shuffled(spark):
    """Without any broadcast too: the exchanges hold narrow rows, and a digest that half of the pages share is no task's alone."""
    rows = [(i, "u", ("same" * 500) if i % 2 else f"page {i} " * 200, None, None) for i in range(4000)]
    pages = spark.createDataFrame(rows, PAGES).repartition(8)
    folder = shared_dir(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spool = warc.write_responses(warc.chunk_table(pages), folder)
        places = warc.written(spool, folder, "places")
        out = warc.write_archives(warc.decided(places, folder), folder)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "payload" not in plan and "chunk" not in plan and "html" not in plan
        assert "Exchange" not in warc.write_responses(warc.chunk_table(pages.sparkSession.read.parquet("/root/testdata/sf0.001/pages.parquet")), folder)._jdf.queryExecution().executedPlan().toString()
        got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.written(out, folder, "manifest"), folder).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(i, "revisit", 3999) if i % 2 and i != 3999 else (i, "response", None) for i in range(4000)}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
