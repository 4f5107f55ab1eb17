from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from duskwire.llm import sharding


def check(docs, n=16):
    rows = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r))
    total, at, want, slots = sum(r[1] for r in rows), 0, [], {}
    for doc_id, size, crc in rows:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        want.append((doc_id, size, crc, "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    have = [tuple(r) for r in sharding.byte_shards(docs, n).collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    return want, total


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_one_pass_in_order(documents, parts):
    want, total = check(documents.repartition(parts))
    sizes = [sum(r[1] for r in want if r[4] == s) for s in range(16)]
    assert max(abs(s - total / 16) for s in sizes) <= max(r[1] for r in want)


def test_odd_rows(clashing, empty):
    check(clashing)
    check(clashing, 3)
    assert sharding.byte_shards(empty).collect() == []


def test_all_in_one_source_or_all_equal(spark):
    check(spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")))
