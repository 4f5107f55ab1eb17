"""The further heuristics on values whose answer is plain to see."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from duskwire.functions import library as L
from duskwire.operators import collections


def answers(spark, f, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [r.x for r in df.select("k", f(*[F.col(f"c{i}") for i in range(len(rows[0]))]).alias("x")).orderBy("k").collect()]


def enc(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


CASES = [
    (L.is_common_word, [("Password",), ("passwords",)], [True, False]),
    (L.is_base64_shape, [("abcd",), ("abc=",), ("abc",), ("",), ("ab\n=",)], [True, True, False, False, False]),
    (L.is_secret_candidate, [("other", "abcdefgh"), ("jwt_token", "abcdefgh"), ("other", "00000000-0000-0000-0000-000000000000"), (None, "abcdefgh"), ("other", "my_secret_label")], [True, False, False, True, False]),
    (L.is_time_zone_data, [("Europe/Paris",), ("01212",), ("Paris",)], [True, True, False]),
    (L.split_camel_or_number, [("parseHTTPResponse2xx",), ("",)], [["parse", "HTTPR", "esponse", "2", "xx"], []]),
    (L.split_camel_case, [("getUserName",), ("",), ("ABC",)], [["get", "User", "Name"], [], ["A", "B", "C"]]),
    (L.is_minified_sequence, [("A1B2 C3D4 E5F6",), ("aB1cD2eF3gH4",), ("plain words",)], [True, True, False]),
    (L.is_analytics_id, [("G-ABCDEFGHIJ",), ("G-1AB2CD3EFG",), ("G-ABC",)], [True, False, False]),
    (L.is_oauth_context, [("oauth token",), ("oauth",)], [True, False]),
    (L.is_basic_auth_syntax, [("Basic dXNlcjpwYXNzd29yZA==", "x"), ("Basic dXNlcjpwYXNzd29yZA==", "an example"), ("Basic", "x")], [False, True, True]),
    (L.is_minified_code, [("a.b.c",), ("one line",), ("x" * 300,)], [True, False, True]),
    (L.has_camel_case, [("userTokenName",), ("fooBar",), ("UserToken",)], [True, False, False]),
    (L.is_origin_trial, [("<meta http-equiv=origin-trial",), ("isThirdParty originTrial",)], [True, False]),
    (L.is_variable_reference, [(" a = b.c ",), ("x.accessToken",), ("a b",)], [True, True, False]),
    (L.is_ui_text, [("Reset Password", ""), ("x", "<LABEL for"), ("x", "y")], [True, True, False]),
    (L.is_google_font_key, [("AIzaX", "webfonts"), ("AIzaX", "maps"), ("x", "webfonts")], [True, False, False]),
    (L.is_dom_selector, [("a:hover", ""), ("hover", ""), ("x", "jQuery"), ("x", "y")], [True, True, True, False]),
    (L.is_ui_header, [("Basic Settings page", "<h1>"), ("Basic Settings", "p")], [True, False]),
    (L.is_jwt, [("eyJhbGciOiJI.eyJzdWIiOiIxMjM0.c2lnbmF0dXJlMTIz",), ("eyJhbGci.eyJzdWIi.c2lnbmF0dXJl",), ("a.b",), (None,)], [True, False, False, False]),
    (L.is_base64_piece_of, [("ab", "c"), ("a" * 12 + "." + "b" * 12 + "." + "c" * 12, "token " + "a" * 12 + "." + "b" * 12 + "." + "c" * 12)], [True, False]),
    (L.is_long_base64_in_code, [("A" * 40, "var x=function(){}"), ("A" * 39, "var x=function(){}"), ("A" * 40, "text")], [True, False, False]),
    (L.is_base64, [("",), ("YQ==",), ("YQ=",), ("Y===",), ("YWJj",)], [True, True, False, False, True]),
    (L.is_data_uri, [("data:image/png;base64,AA",), ("data:image/png,AA",)], [True, False]),
    (L.is_binary_base64, [(enc(b"\xff\xd8abc"),), (enc(b"plain text here"),), (enc(bytes(range(1, 31))),), ("?",), ("",)], [True, False, True, False, False]),
    (L.is_secret_in_base64, [(enc(b"the password is in here"),), (enc(b"nothing of note is here."),), (enc(b"key"),)], [True, False, False]),
    (L.is_timeout_error, [("Deadline Exceeded",), ("x",)], [True, False]),
    (L.is_rate_limit_error, [("HTTP 429", None), ("HTTP 429", "waf"), ("x", "rate_limit")], [True, False, True]),
    (L.split_lines, [("a\r\nb\rc\n\nd",), ("",)], [["a", "b", "c", "d"], []]),
    (L.sanitize_url, [(" a.test ",), ("http://a.test?q",), ("https://a.test/x",)], ["https://a.test/", "http://a.test/?q", "https://a.test/x"]),
    (L.enforce_script_extension, [("http://a.test/x?v=1",), ("http://a.test/x.js?v=1",), ("http://a.test/x",)], ["http://a.test/x.js?v=1", "http://a.test/x.js?v=1", "http://a.test/x.js"]),
    (L.file_extension, [("/a/b.TXT",), ("/a.b/c",), (".env",)], [".txt", "", ".env"]),
    (L.is_text_file, [("a.py",), ("a",), ("a.exe",)], [True, True, False]),
    (L.is_script_file, [("http://a/js/x",), ("/x.JS",), ("/x.css",)], [True, True, False]),
]


@pytest.mark.parametrize(("f", "rows", "want"), CASES, ids=[c[0].__name__ for c in CASES])
def test_values(spark, f, rows, want):
    assert answers(spark, f, *rows) == want


def test_sizes_and_durations(spark):
    n = spark.createDataFrame([(0,), (1023,), (1024,), (1536 * 1024,), (5 * 1024**4,)], "n long").select(L.format_bytes(F.col("n")).alias("x")).collect()
    assert [r.x for r in n] == ["0 B", "1023 B", "1.0 KB", "1.5 MB", "5.0 TB"]
    s = spark.createDataFrame([(1.5,), (61.0,), (3725.25,)], "s double").select(L.format_duration(F.col("s")).alias("x")).collect()
    assert [r.x for r in s] == ["1.50 seconds", "1 minutes 1.00 seconds", "1 hours 2 minutes 5.25 seconds"]


def test_a_cache_keeps_what_was_used_last():
    c = collections.RecentCache(2)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert "b" not in c and c.keys() == ["a", "c"] and len(c) == 2 and c.get("b", 9) == 9
    c.remove("a")
    c.remove("a")
    assert c.keys() == ["c"]
    c.clear()
    assert len(c) == 0


def test_chunks_of_no_size_are_one(spark):
    rows = collections.chunks(spark.range(5).withColumn("g", F.lit(0)), 0, ["g"], ["id"]).collect()
    assert {r.chunk for r in rows} == {0}
