from __future__ import annotations

import random
from fractions import Fraction

import pytest
import regex
from pyspark.sql import functions as F

from duskwire.llm import decontam


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def expected(docs, items, threshold=0.8):
    out = {}
    for d, t in docs:
        dw = words(t)
        by = {k: shingles(dw, k) for k in range(1, 6)}
        for i, it in items:
            iw = words(it)
            if not iw:
                continue
            k = min(5, len(iw))
            own = shingles(iw, k)
            n = len(own & by[k])
            if Fraction(n, len(own)) >= Fraction(str(threshold)):
                out[d, i] = max(out.get((d, i), (0,)), (n / len(own), n, len(own)))
    return {(d, i, size, n) for (d, i), (_, n, size) in out.items()}


def run(docs, items):
    rows = decontam.contained_items(docs, items).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in rows}


def pairs(df, a, b):
    return [(r[0], r[1]) for r in df.select(a, b).collect()]


def test_against_brute_force(spark, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = expected(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert want and run(documents, items) == want


def test_near_passages(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for k in range(40)]
    docs = []
    for k in range(120):
        w = items[k % 40][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        pad = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        docs.append((k, " ".join([*pad(), *w, *pad()])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(d, i) == expected(docs, items)


def test_odd_rows(spark, clashing):
    items = [(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, "quick brown fox jumps over the lazy dog"), (3, None), (4, ""), (5, "..."), (6, "two words"), (None, "漢字漢字"), (7, "other words entirely not in here")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5)).withColumn("width", F.lit(1)).withColumn("copy", F.lit(1))
    assert run(clashing, table) == expected(pairs(clashing, "doc_id", "text"), items)
    left = decontam.decontaminate(clashing, table)
    bad = {d for d, *_ in expected(pairs(clashing, "doc_id", "text"), items)}
    assert left.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in clashing.collect() if r.doc_id not in bad)


@pytest.mark.parametrize("which", ["docs", "items", "both"])
def test_empty_tables(spark, documents, empty, which):
    items = spark.createDataFrame([] if which != "docs" else [(1, "a b c d e f")], "item_id long, text string")
    docs = documents if which == "items" else empty
    assert run(docs, items) == set()
    assert decontam.decontaminate(docs, items).count() == docs.count()


def test_a_sketch_always_meets_the_contained(spark):
    items = spark.createDataFrame([(k, " ".join(f"x{j}" for j in range(k + 5))) for k in range(60)], "item_id long, text string")
    made = decontam.item_shingles(items, "item_id", "text", 5)
    for r in decontam.sketches(made, 0.8).groupBy("item_id").count().collect():
        n = r.item_id + 1
        assert r["count"] > n - (4 * n + 4) // 5
