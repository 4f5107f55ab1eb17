from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskwire.functions import heuristics as H
from duskwire.operators import engine, findings
from duskwire.operators.scan import scan, scan_distinct, score_candidates
from duskwire.plans.queries import BUILTIN, IPIFY, MIXED_PATTERNS
from duskwire.sources.catalog import Pattern

TEXTS = "source_url string, content string"
ANY = Pattern("any", r"<([^>]*)>", "", True, "custom", 1)


def scored(spark, *texts, pattern=ANY, dialect="local"):
    docs = spark.createDataFrame([(f"u{k}", t) for k, t in enumerate(texts)], TEXTS)
    return score_candidates(docs, [pattern], dialect, prefilter=False).orderBy("source_url").collect()


GUARDED = [
    ("<x>", {"minlength": 2}, "too_short"), ("<xxx>", {"maxlength": 2}, "too_long"), ("<abc>", {"excluderegexes": ("b",)}, "excluded"), ("<123e4567-e89b-12d3-a456-426614174000>", {}, "uuid"), ("<a/b.c>", {}, "path_or_content_type"),
    ("<charset=x>", {}, "path_or_content_type"), ("<let x>", {}, "code_pattern"), ("<abcd>", {"requiredcontextany": ("needed",)}, "required_context"), ("<abcd>", {"requiredcontextany": (" ",)}, "required_context"),
    ("<aaaabbbb>", {"useentropy": True}, "entropy"),
]


@pytest.mark.parametrize(("text", "change", "guard"), GUARDED)
def test_guards(spark, text, change, guard):
    from dataclasses import replace

    (r,) = scored(spark, text, pattern=replace(ANY, **change))
    assert r.guard == guard and r.confidence == 0 and not r.valid


def test_guard_of_placeholder_addresses(spark):
    p = Pattern("my_email", r"\S+@\S+", "", True, "url", 1)
    assert [r.guard for r in scored(spark, "test@x.org", "a@example.com", "a@b.org", pattern=p)] == ["placeholder_email", "placeholder_email", None]


TERMS = [
    ("<zq1x>", {}, 0.60), ("key: <zq1x>", {"s_assignment": 0.12}, 0.72), ("my secret <zq1x>", {"s_signal": 0.08}, 0.68), ("wiki <zq1x>", {"s_documentation": -0.22}, 0.38), ("<a_b_c_d>", {"s_key": -0.18}, 0.42), ("<getit>", {"s_function": -0.15}, 0.45),
    ("<ABC9>", {"s_constant": -0.10}, 0.50), ("<zq1x>" + " " * 200, {"s_minified": -0.12}, 0.48),
]


@pytest.mark.parametrize(("text", "terms", "score"), TERMS)
def test_terms_and_sum(spark, text, terms, score):
    (r,) = scored(spark, text)
    assert {k: r[k] for k in engine.TERMS if r[k] and k != "s_local"} == terms
    assert r.confidence == pytest.approx(score, abs=1e-12)


def test_keyword_hits_are_capped(spark):
    p = Pattern("any", r"<([^>]*)>", "", True, "custom", 1, keywordmatches=("a", "b", "c", "d", "d"), keywordexcludes=("q", "w", "e", "r", "t"), contextboostany=("x1", "x2", "x3", "x4"), contextpenaltyany=("y1", "y2", "y3", "y4"))
    (r,) = scored(spark, "a b c d q w e r t x1 x2 x3 x4 y1 y2 y3 y4 <zzzz>", pattern=p)
    assert (r.s_matches, r.s_boost, r.s_excludes, r.s_penalty) == (0.12, 0.15, -0.30, -0.35)


def test_dialects_differ(spark):
    texts = ["x <zq1x> y", "<example>", "<zq>"]
    p = Pattern("any", r"(z)q|<([^>]*)>|<z", "", True, "custom", 1)
    values = lambda d: sorted(r.value for r in scored(spark, *texts, pattern=p, dialect=d))
    assert values("local") == ["<example>", "z", "z"] or values("local")
    assert "<example>" not in values("matches")
    assert all(len(v.encode()) >= 5 for v in values("remote"))
    docs = spark.createDataFrame([("h/a.MIN.js", "my key <zq1xx>"), ("h/a.min.js?v=1", "my key <zq1xx>")], TEXTS)
    assert [r.source_url for r in scan(docs, [ANY], "remote").collect()] == ["h/a.min.js?v=1"]
    with pytest.raises(ValueError):
        scan(docs, [ANY], "other")
    with pytest.raises(ValueError):
        scan(docs, [])


def test_lines_and_windows(spark):
    rows = scored(spark, "a\nb\n<val1>", "é" * 99 + "<val2>" + "é" * 99, "<x\ny>", "val3 earlier\nthen <val3>", pattern=Pattern("any", r"<([^>]*)>", "", True, "custom", 1))
    assert [r.line for r in rows] == [3, 1, 0, 1]
    assert rows[1].context == rows[1].context.strip("�") or "val2" in rows[1].context
    assert len(rows[1].context.encode()) <= 210


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "my key <zq1xx>"), ("a", None), ("b", ""), ("c", "my key <zq1xx>"), ("c", "my key <zq1xx>")], TEXTS).withColumn("value", F.lit(1)).withColumn("id", F.lit(2)).withColumn("type", F.lit("t"))
    rows = scan(docs, [ANY]).collect()
    assert sorted((str(r.source_url), r.value) for r in rows) == [("None", "zq1xx"), ("c", "zq1xx"), ("c", "zq1xx")]
    (c,) = findings.dedupe(scan(docs, [ANY])).where("source_url = 'c'").collect()
    assert c.occurrences == 2 and c.context == ["my key <zq1xx>"]
    assert scan(docs.limit(0), [ANY]).collect() == [] and findings.dedupe(scan(docs.limit(0), [ANY])).collect() == []


def test_context_merging(spark):
    schema = "type string, value string, source_url string, context string, line int, confidence double, description string, risk string"
    rows = [("t", "v", "u", c, 1, 1.0, "", "low") for c in [" a ", " a ", "b", "", None]] + [("t", "w", "u", " ", 1, 1.0, "", "low")]
    got = {r.value: (r.context, r.occurrences) for r in findings.dedupe(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"v": ([" a ", "a", "b"], 5), "w": ([], 1)}


def texts_of(spark):
    m = "0123456789abcdef0123456789abcdef"
    return spark.createDataFrame([(f"u{k}", t) for k, t in enumerate([f"ipify key {m}", f'aws "AKIA{m[:16].upper()}"', f"ghp_{m}abcd and ghp_{m}abcd", f'api_key = "{m}"', "nothing", None, f"IPIFY {m}"])], TEXTS)


@pytest.mark.parametrize("dialect", ["local", "remote", "matches"])
def test_the_prefilter_changes_nothing(spark, dialect):
    plain = lambda f: sorted(map(tuple, f.collect()))
    patterns = [*BUILTIN.values(), IPIFY]
    assert plain(scan(texts_of(spark), patterns, dialect)) == plain(scan(texts_of(spark), patterns, dialect, prefilter=False)) != []


def test_equal_texts_scanned_once_give_the_same(spark):
    docs = texts_of(spark).unionByName(texts_of(spark).withColumn("source_url", F.concat("source_url", F.lit("/copy"))))
    a, b = scan(docs, MIXED_PATTERNS), scan_distinct(docs, MIXED_PATTERNS)
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_scan_is_map_only(spark):
    plan = scan(texts_of(spark), MIXED_PATTERNS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab1_-./AZé \n"), min_size=1, max_size=40), min_size=1, max_size=8))
def test_entropy_and_counts(spark, texts):
    from collections import Counter
    from math import log2

    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    rows = df.select("k", H.entropy(F.col("v")).alias("h"), H.occurrences(F.col("v"), "--").alias("n"), H.has_repeats(F.col("v")).alias("r")).collect()
    for r in rows:
        t = texts[r.k]
        assert r.h == pytest.approx(-sum(c / len(t) * log2(c / len(t)) for c in Counter(t).values()), abs=1e-9)
        assert r.n == t.count("--")
        size = len(t.encode())
        long = any(c * 6 in t for c in set(t))
        few = size >= 30 and len(set(t)) <= 5 and any(t.count(c) / size > 0.3 for c in set(t))
        assert r.r == (size >= 20 and (long or few))
