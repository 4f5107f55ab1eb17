"""value_heuristics looks at whole pages: its SQL without the cut gives the same rows."""

from __future__ import annotations

import duckdb

from duskwire.plans import queries
from tests.test_queries import plain


def test_values_beyond_the_first_2000_characters(spark, tmp_path):
    d = str(tmp_path)
    long = "<p>" + "lorem ipsum " * 200 + "<b>getUserToken</b><i>late_value_here_x</i>"
    spark.createDataFrame([(1, "http://a.test/x", long), (2, "http://b.test/y", None), (3, "http://c.test/z", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([("red tin", "SMALL")], "p_name string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([("Customer#1",)], "c_name string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(1, "some text")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    df = queries.value_heuristics(spark, d)
    con = duckdb.connect()
    for t in ("pages", "part", "customer", "documents"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES["value_heuristics"].replace("substr(html, 1, 2000)", "html"))
    at = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in df.columns) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in df.columns) for r in df.collect()), key=str) == want
    assert "late_value_here_x</i" in {r.v for r in df.select("v").collect()}
