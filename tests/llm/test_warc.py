from __future__ import annotations

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from duskwire.llm import warc
from duskwire.llm.common import fresh_path

PAGES = "page_id long, url string, html string"


def expected(rows):
    first: dict[bytes, int] = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if page_id is not None:
            first[raw] = min(first.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        own = first.get(raw)
        revisit = own is not None and own != page_id
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", own if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_roundtrip_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(warc.roundtrip(pages, fresh_path(spark, "w"))) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_odd_pages(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (2, None, "same"), (0, "http://b/\r\nX: y", None), (5, "u", ""), (None, "u", "same"), (7, "u", "é" * 200_000), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).withColumn("sha", F.lit(1))
    assert got(warc.roundtrip(pages, fresh_path(spark, "w"))) == expected(rows)


def test_no_pages(spark):
    assert got(warc.roundtrip(spark.createDataFrame([], PAGES), fresh_path(spark, "w"))) == []


def test_predicates_are_pushed_and_payloads_skipped(spark):
    path = fresh_path(spark, "w")
    warc.write_warc(warc.page_records(spark.createDataFrame([(k, f"http://h{k % 3}/p", f"page {k // 2}") for k in range(20)], PAGES)), path)
    some = warc.read_warc(spark, path, payload=False).where("record_type = 'response' and target_uri like 'http://h1%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan and "Filter [" not in plan
    rows = some.collect()
    assert rows and all(r.record_type == "response" and r.target_uri.startswith("http://h1") and r.payload is None for r in rows)


def test_foreign_archives(spark, tmp_path):
    record = lambda kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record("warcinfo", b"software: x") + record("resource", b"body"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("metadata", b"m" * 3_000_000)) + gzip.compress(record("resource", b"second")))
    rows = warc.read_warc(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"body", b"second"]


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    import pytest

    digest = warc.base32_sha1(b"right")
    (tmp_path / "a.warc").write_bytes(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: 5\r\n\r\nwrong\r\n\r\n".encode())
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_warc(spark, str(tmp_path), verify=True).collect()


def test_no_payload_moves_for_a_digest_that_most_rows_share(spark):
    """Few revisits are broadcast; many meet the payloads on (id, digest), which spreads a hot digest over all partitions."""
    from duskwire.llm import common

    rows = [(k, "u", "hot" if k % 3 else f"page {k}") for k in range(3000)]
    pages = spark.createDataFrame(rows, PAGES)
    plan = warc.page_records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    was, common.BROADCAST_ROWS = common.BROADCAST_ROWS, 0
    defaults = common.broadcast_if_small.__defaults__
    common.broadcast_if_small.__defaults__ = (0, 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = warc.page_records(pages)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "page_id" in plan.split("hashpartitioning(")[1]
        assert made.where("record_type = 'revisit'").count() == 1999
        assert got(warc.roundtrip(pages, fresh_path(spark, "w"))) == expected(rows)
    finally:
        common.broadcast_if_small.__defaults__, common.BROADCAST_ROWS = defaults, was
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_record_without_a_length_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nbody\r\n\r\n")
    with pytest.raises(Exception, match="without Content-Length"):
        warc.read_warc(spark, str(tmp_path)).collect()
