"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from duskwire.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    have = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    cur = con.execute(queries.ORACLES[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at.index(c)]) for c in names) for r in cur.fetchall()), key=str)
    assert have == want and have


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 1500 and rows.where("confidence < 1.0").count() == 0


def test_all_queries_have_sql_or_a_reason():
    # The whole catalog as SQL is too slow on whole tables; tests/test_whole_catalog.py has it on a fixture.
    assert queries.QUERIES.keys() - queries.ORACLES.keys() == {"scan_catalog_all_texts"} and queries.ORACLES.keys() <= queries.QUERIES.keys()
    assert queries.QUERIES.keys() <= entry.queries().keys()


def test_only_the_entry_knows_the_optional_part():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "duskwire").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "duskwire.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
