"""What keeps a scan's time in proportion to its texts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from duskwire.functions import heuristics as H
from duskwire.operators import scan as S
from duskwire.plans import queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_compiled_and_texts_made_after_they_are_dealt_out(spark, sf_dir):
    text = plan(queries.shared(spark, sf_dir))
    assert "s_minified" in text and not re.search(r"Generate explode\(transform\([^\n]*s_minified", text)
    assert "md5" in text and "md5" not in text[text.index("Exchange RoundRobin") :]


def test_tasks_of_texts_follow_the_input(spark, tmp_path):
    def tasks(n):
        spark.range(n).selectExpr("id as o_orderkey", "id % 1000 as o_custkey", "md5(cast(id as string)) as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/{n}/orders.parquet")
        return queries.order_texts(spark, f"{tmp_path}/{n}", queries.SHARED).rdd.getNumPartitions()

    assert 4 <= tasks(1000) <= 8 < 20 < tasks(500_000)


def test_bounds_of_entropy_hold(spark):
    draw = random.Random(1)
    texts = ["", "a", "aaaa", "abcdefgh", "aabb", "é" * 7 + "x"] + ["".join(draw.choices("ab1_-Zé"[: draw.randint(1, 7)], k=draw.randint(1, 40))) for _ in range(200)]
    v = F.col("v")
    least, most = H.entropy_bounds(v, F.size(H.distinct_characters(v)))
    for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", H.entropy(v).alias("h"), least.alias("least"), most.alias("most")).collect():
        assert r.least - 1e-9 <= r.h <= r.most + 1e-9, r


def test_one_expression_finds_all_literals(spark):
    """Literals that begin, lie in or overlap one another."""
    words = ["key", "keypad", "pad", "padlock", "ey", "a.b", "sk-", "sk-or-v1-", "or-", "ike", "é-x"] + [f"{c}zz" for c in "bcdfghij"]
    draw = random.Random(2)
    texts = ["", "none here", "keypadlock sk-or-v1-", "é-xa.b"] + ["".join(draw.choices(words + ["x", " ", "ke", "sk"], k=6)) for _ in range(100)]
    by = {w: [i] for i, w in enumerate(words)}
    held = F.array_distinct(F.regexp_extract_all("t", F.lit(S.trie_regex(words)), F.lit(1)))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S._known(by, F.array_remove(held, "")).alias("ids")).collect():
        assert sorted(r.ids) == [i for i, w in enumerate(words) if w in r.t], r


def test_counts_of_marks_are_spared_only_where_there_are_none(spark):
    each = [t for t in [*H.MINI_MARKS, *H.MINI_BLOCKS, *H.OPERATORS]]
    rows = spark.createDataFrame([(f"a {t}b",) for t in each] + [("plain words: a = b",)], "c string").select("c", H.is_busy(F.col("c")).alias("busy")).collect()
    assert [r.c for r in rows if not r.busy] == ["plain words: a = b"]


def test_no_row_tries_hundreds_of_branches():
    sql = S._values([*queries.ENABLED, queries.IPIFY], "local")
    assert max(len(re.findall(r"WHEN \d+ THEN", part)) for part in sql.split("CASE id ")) <= 4
    assert sorted(map(int, re.findall(r"WHEN (\d+) THEN", sql))) == list(range(len(queries.ENABLED) + 1))


def test_a_stream_deals_its_rows_out_before_texts_are_made(spark, sf_dir):
    from duskwire.plans import more_queries

    text = more_queries._shared_stream(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "md5" in text[: text.index("Repartition")] and "md5" not in text[text.index("Repartition") :]
